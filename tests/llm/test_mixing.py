from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkshelf.llm import mixing as M


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        goal = {s: left * weight[s] / total for s in free}
        over = [s for s in free if goal[s] > 3 * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: 3.0 * sizes[s] for s in over}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 10_000), min_size=1, max_size=7))
def test_targets(sizes):
    got, want = M.targets(sizes), brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)
        assert got[s] <= 3 * sizes[s] + 1e-6


def test_flow_prefers_fresh_words():
    flow = M.min_cost_flow([(("a",), 100), (("a", "b"), 100), (("b",), 10)], {"a": 120, "b": 90})
    assert sum(f.get("a", 0) for f in flow) == 120 and sum(f.get("b", 0) for f in flow) == 90
    assert all(sum(f.values()) <= n for f, n in zip(flow, (100, 100, 10)))  # nothing repeats


def corpus(spark, n=900):
    words = lambda k: " ".join(["w"] * k)
    rows = [(i, words(1 + i * 7 % 60), ["b", "a", None, "ä", "c"][i % 5 if i % 3 else 0]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "b"), rows[1], rows[1]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def test_each_source_comes_near_its_target(spark):
    docs, rows = corpus(spark)
    out, shares = M.mix(docs, F.array("source"))
    got = out.collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        sizes[r["members"][0]] += r["size"]
        taken[r["members"][0]] += r["taken"]
    goal = brute_targets(dict(sizes))
    for s, g in goal.items():
        assert abs(taken[s] - g) <= 60, s
    assert {r["source"]: (r["source_size"], round(r["target"], 3)) for r in shares.collect()} == {s: (sizes[s], round(g, 3)) for s, g in goal.items()}
    again = {(r["doc_id"], r["size"]): r["taken"] for r in M.mix(docs.repartition(5), F.array("source"))[0].collect()}
    assert all(again[r["doc_id"], r["size"]] == r["taken"] for r in got)


def test_rows_repeat_as_planned(spark):
    docs, _ = corpus(spark, 200)
    copies = defaultdict(int)
    for r in M.mix(docs, F.array("source"))[0].collect():
        copies[r["doc_id"]] += r["copies"]
    out = M.mixed(docs, F.array("source"))
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert got == {k: v for k, v in copies.items() if v}


def test_overlapping_sources_and_empty_tables(spark, docs, none):
    d, _ = corpus(spark, 300)
    members = F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("z"))).otherwise(F.array("source"))
    out, shares = M.mix(d, members)
    total = sum(r["size"] for r in out.collect())
    assert abs(sum(r["taken"] for r in out.collect()) - total) < 0.1 * total
    assert abs(sum(r["target"] for r in shares.collect()) - total) < 1
    out, shares = M.mix(none, F.array("source"))
    assert out.count() == 0 and shares.count() == 0
    assert M.mixed(none, F.array("source")).count() == 0
    assert M.mix(docs, F.array("source"))[0].count() == docs.count()
