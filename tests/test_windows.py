from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkshelf.operators import joins as J
from sparkshelf.operators import windows as W


def greedy(segments, least):
    out, text, start, total = [], None, None, 0.0
    for t, s, d in segments:
        text, start, total = t if text is None else f"{text} {t}", s if start is None else start, total + d
        if total >= least:
            out.append((text, start, total))
            text, start, total = None, None, 0.0
    return out + ([(text, start, total)] if text is not None else [])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b b", ""]), st.floats(0, 100), st.sampled_from([0.0, 10.0, 44.9, 45.0, 90.0])), max_size=9))
def test_greedy_windows(spark, segments):
    df = spark.createDataFrame([(1, segments)], "i int, s array<struct<text string, start double, duration double>>")
    got = [tuple(x) for x in df.select(W.greedy_windows(F.col("s")).alias("w")).first()["w"]]
    assert got == greedy(segments, 45.0)


def test_dedup_keeps_null_groups_and_places(spark):
    rows = [(1, "a", 100.0), (2, None, 5.0), (3, "a", 60.0), (4, "b", 70.0), (5, None, 5.0), (6, "a", 40.0), (7, "b", None)]
    df = spark.createDataFrame(rows, "rank int, g string, price double")
    assert sorted(r["rank"] for r in W.dedup_first(df, "g", "rank").collect()) == [1, 2, 4, 5]
    got = [(r["place"], r["rank"]) for r in W.dedup_closest(df, "g", "rank", "price", 50.0).orderBy("place").collect()]
    assert got == [(1, 3), (2, 2), (4, 4), (5, 5)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6), st.integers(0, 9)), max_size=12, unique_by=lambda x: x[:2]), st.booleans())
def test_as_of(spark, left, right, strict):
    a = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "i int, k int, t int")
    b = spark.createDataFrame(right, "k int, t int, v int")
    got = {r["i"]: r["v_as_of"] for r in J.as_of(a, b, "k", "t", "v", strict).collect()}
    want = {}
    for i, (k, t) in enumerate(left):
        before = [(rt, v) for rk, rt, v in right if rk == k and (rt < t or rt == t and not strict)]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_allocation_needs_equal_sums(spark):
    rows = spark.createDataFrame([("j", i) for i in range(4)] + [("k", 9)], "g string, i int")
    shares = spark.createDataFrame([("j", "x", 1), ("j", "y", 3), ("k", "z", 2), ("j", "w", 0)], "g string, name string, n int")
    got = sorted((r["g"], r["i"], r["name"]) for r in J.allocate(rows, "g", ["i"], shares, "name", "n").collect())
    assert got == [("j", 0, "x"), ("j", 1, "y"), ("j", 2, "y"), ("j", 3, "y")]


def test_division(spark):
    kits = spark.createDataFrame([("a",), ("b",)], "chip string")
    allowed = spark.createDataFrame([("a", "m", "1"), ("a", "s", "2"), ("b", "m", "1"), ("b", "m", "1")], "chip string, grp string, value string")
    wanted = spark.createDataFrame([("m", "1"), ("s", "2")], "grp string, value string")
    assert [r["chip"] for r in J.divide(kits, "chip", allowed, None, "grp", "value", wanted).collect()] == ["a"]


def test_semi_any_has_no_nested_loop(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "x int, y int")
    b = spark.createDataFrame([(1, None), (9, 7)], "p int, q int")
    out = J.semi_any(a, b, [("x", "p"), ("y", "q")])
    assert sorted(r["x"] for r in out.collect()) == [1, 3]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
