import bisect

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkshelf.operators import retrieval as R
from sparkshelf.operators import scoring as S
from sparkshelf.operators import windows as W

SCHEMA = "id bigint, brand string, family string, status string, price double, cpu_mark bigint, gpu_mark bigint, gpu_is_proxy boolean, ram_gb int, storage_gb int, storage_type string, weight_kg double, display_size double, battery_wh double, cpu_model string"
ROWS = [
    (1, "A", "f1", "active", 3000.0, 100, 50, False, 8, 512, "SSD", 1.2, 13.3, 60.0, "i5"), (2, "A", "f1", "active", 3000.0, 100, 50, False, 8, 512, "SSD", 1.2, 14.0, 60.0, "i7"),
    (3, "B", "f2", "active", 0.0, None, 80, True, 16, 1024, "1TB HDD", None, 16.0, 90.0, None), (4, "B", None, "active", 36999.0, 900, None, False, 128, 4096, "SSD", 3.7, 18.0, 99.0, "i9"),
    (5, "C", None, "inactive", 10.0, 5, 5, False, 4, 128, "eMMC HDD", 0.9, 11.0, 30.0, "m3"), (6, "C", "f3", "active", 5000.0, None, None, None, 16, 512, None, 2.0, 15.6, 70.0, "Ryzen 7"), (7, "C", "f2", "active", 4200.5, 300, 70, True, 32, 1000, "SSD", 1.8, 15.0, 75.0, "i7"),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def plain(row, rows, weights, pref=None):
    """The score of one row by the formulas, in plain Python."""
    r = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], row))
    active = [dict(zip(r, x)) for x in rows if x[3] == "active"]

    def p(c, ok=lambda v: True):
        v, vs = r[c], sorted(float(a[c]) for a in active if a[c] is not None and ok(a[c]))
        if v is None or not vs:
            return 50.0
        lo = bisect.bisect_left(vs, v)
        return (lo + (bisect.bisect_right(vs, v) - lo) / 2) / len(vs) * 100

    price = 50.0 if r["price"] == 0 else 100 - p("price", lambda v: v > 0)
    top = ((pref or {}).get("budget") or {}).get("max")
    if r["price"] and top and r["price"] > top:
        price *= max(0.0, 1 - 2 * (r["price"] - top) / top)
    disk = p("storage_gb")
    if "hdd" in (r["storage_type"] or "").lower():
        disk = max(0.0, disk - 15)
    screen = 50.0
    if pref and pref.get("screen_size"):
        goal = next((i for i, t in enumerate((("13", "14"), ("15", "16"))) if any(x in pref["screen_size"][0] for x in t)), 2)
        own = 0 if r["display_size"] <= 14 else 1 if r["display_size"] <= 16 else 2
        screen = max(0.0, 100 - 40 * abs(goal - own))
    liked = [b.lower() for b in (pref or {}).get("brand_preferences") or []]
    brand = 50.0 if not liked or "no preference" in liked else 100.0 if r["brand"].lower() in liked else 50.0
    factors = {"price": price, "cpu": p("cpu_mark"), "gpu": p("gpu_mark"), "ram_storage": 0.6 * p("ram_gb") + 0.4 * disk, "portability": 50.0 if r["weight_kg"] is None else 100 - p("weight_kg"), "battery": p("battery_wh"), "screen_size": screen, "brand": brand}
    total = sum(factors[f] * weights[f] for f in factors)
    return None if r["cpu_mark"] is None and r["gpu_mark"] is None else int(max(0, min(100, round(total)))), factors


PREF = {"budget": {"min": 1, "max": 3500.0}, "priorities": {"cpu": 5, "price": 3}, "purpose": ["Gaming", "Programming/Development"], "portability": "Yes please", "screen_size": ["15-16"], "brand_preferences": ["b"]}


def test_every_profile_matches_plain_python(products):
    got = {(r["id"], r["use_case"]): r for r in S.score(S.with_percentiles(products), S.PROFILES).collect()}
    assert len(got) == len(ROWS) * len(S.PROFILES)
    for row in ROWS:
        for name, profile in S.PROFILES.items():
            want, factors = plain(row, ROWS, S.weights(profile=profile))
            r = got[row[0], name]
            assert r["score"] == want
            assert [b["factor"] for b in r["breakdown"]] == list(S.FACTORS)
            for b in r["breakdown"]:
                assert b["raw_score"] == pytest.approx(factors[b["factor"]], abs=0.0101)
    assert got[6, "gaming"]["flags"]["score_withheld"] and got[3, "gaming"]["flags"]["price_unavailable"]


def test_personal_scores(products):
    got = {r["id"]: r["score"] for r in S.score(S.with_percentiles(products), preference=PREF).collect()}
    w = S.weights(PREF)
    assert sum(w.values()) == pytest.approx(1)
    assert got == {row[0]: plain(row, ROWS, w, PREF)[0] for row in ROWS}


def test_values_outside_the_catalog(products):
    own = S.configured(products.where("id = 1"), {"price": F.lit(3500.0), "ram_gb": F.lit(48)})
    got = S.score(S.with_percentiles(own, products), S.PROFILES).collect()
    row = (*ROWS[0][:4], 3500.0, *ROWS[0][5:8], 48, *ROWS[0][9:])
    assert {r["use_case"]: r["score"] for r in got} == {n: plain(row, ROWS, S.weights(profile=p))[0] for n, p in S.PROFILES.items()}


def test_gaming_ranking_puts_stand_ins_last(products):
    scored = S.score(S.with_percentiles(products), S.PROFILES)
    ids = [r["id"] for r in S.ranking(scored, "gaming", "family").collect()]
    assert 6 not in ids and len({1, 2} & set(ids)) == 1
    late = [i in (3, 7, 4) for i in ids]
    assert late == sorted(late)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(S.FACTORS), st.integers(1, 9)), st.lists(st.sampled_from(list(S.PURPOSES)), max_size=3), st.sampled_from(["Yes", "No", "Neutral", None, "?"]))
def test_weights_add_up(priorities, purpose, portability):
    w = S.weights({"priorities": priorities, "purpose": purpose, "portability": portability})
    assert sum(w.values()) == pytest.approx(1) and all(v > 0 for v in w.values())


def test_purpose_labels():
    assert S.purpose_label("  office/study ") == "Office/Study"
    for bad in (None, "Office", ""):
        with pytest.raises(ValueError):
            S.purpose_label(bad)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 20)), min_size=1, max_size=40))
def test_midpoint_percentile(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    known = sorted(v for v in values if v is not None)
    for r in W.midpoint_percentile(df, "v").collect():
        if r["v"] is None:
            assert r["percentile"] is None
        else:
            lo, hi = bisect.bisect_left(known, r["v"]), bisect.bisect_right(known, r["v"])
            assert r["percentile"] == pytest.approx((lo + hi) / 2 / len(known) * 100)


def test_penalty_bands(spark):
    df = spark.createDataFrame([(p,) for p in (900.0, 1000.0, 1100.0, 1100.01, 1300.0, 1300.5)], "price double")
    got = [round(r[0], 6) for r in df.select(R.budget_penalty(df.price, 1000.0)).collect()]
    assert got == [1.0, 1.0, 0.8, pytest.approx(0.849985), pytest.approx(0.55), 0.1]
    df = spark.createDataFrame([(w,) for w in (None, 2.0, 2.4, 2.41)], "w double")
    assert [r[0] for r in df.select(R.weight_penalty(df.w, 2.0)).collect()] == [1.0, 1.0, 0.7, 0.2]


def test_relaxation_takes_the_first_viable_step(spark):
    v = lambda x: [x, (1 - x * x) ** 0.5]
    rows = [(1, "a", "f", 900.0, 3.0, v(0.6), "i5"), (2, "a", "g", 1400.0, 1.0, v(0.9), "i5"), (3, "b", "h", 950.0, 2.3, v(0.7), "i5")]
    p = spark.createDataFrame(rows, "id bigint, brand string, family string, price double, weight_kg double, embedding array<double>, cpu_model string")
    step = lambda c: {(r["step"], r["field"]) for r in R.relaxed(p, [1.0, 0.0], c).collect()}
    assert step(R.Constraints(budget=1000.0)) == {(0, None)}
    assert step(R.Constraints(budget=1000.0, weight_limit=1.75)) == {(1, "weight_limit")}
    assert step(R.Constraints(budget=500.0, brands=("a",), weight_limit=0.9)) == {(4, "budget")}
    assert step(R.Constraints(budget=100.0, weight_limit=0.1)) == set()
    assert [s for s, _, _ in R.ladder(R.Constraints(budget=1.0, weight_limit=1.0))] == [0, 1, 2, 3, 4, 5]
    gated = R.gate(R.rerank(R.recall(p, [0.0, -1.0]), R.Constraints())).first()
    assert gated["status"] == "gated" and gated["bottleneck"] == "general"
    assert [r["id"] for r in R.search(p, [1.0, 0.0], R.Constraints(budget=1000.0)).collect()] == [3, 1]
