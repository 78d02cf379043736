"""Probes in texts against regular expressions, one probe and one text at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import probes as P

SEGMENTS = "key bigint, source string, place int, text string, seconds bigint"


def plainly(segments, probes, most=2, around=70):
    sources = {}
    for key, source, place, text, seconds in sorted(segments, key=lambda s: (s[0], s[1], s[2], s[3] or "")):
        if text:
            sources.setdefault((key, source), []).append((text, seconds))
    found = set()
    for (key, source), parts in sources.items():
        whole, starts = " ".join(t for t, _ in parts), []
        at = 0
        for t, s in parts:
            starts.append((at, s))
            at += len(t) + 1
        for p in probes:
            if not p:
                continue
            pattern = re.compile((r"\b" if p[0].isalnum() else "") + re.escape(p) + (r"\b" if p[-1].isalnum() else ""), re.IGNORECASE)
            for n, m in enumerate(pattern.finditer(whole), 1):
                if n > most:
                    break
                context = re.sub(r"\s+", " ", whole[max(0, m.start() - around) : m.end() + around]).strip()
                found.add((key, source, p, n, m.start(), m[0], context, [s for a, s in starts if a <= m.start()][-1]))
    return found


def frames(spark, segments, probes):
    return spark.createDataFrame(segments, SEGMENTS).repartition(3), spark.createDataFrame([(p,) for p in probes], "probe string")


def test_bounds_overlaps_and_seconds(spark):
    segments = [
        (1, "description", 0, "gm30 tool, then m3 chip; M3, xm3 m3x _m3 m3", None),
        (2, "transcript", 1, "it has 32", 15), (2, "transcript", 0, "well", 0), (2, "transcript", 2, "GB and 512GB, not 2512GB", 30), (2, "transcript", 3, "", 45), (2, "transcript", 4, None, 50),
        (3, "transcript", 0, "aaaa aa (x) (x)(x) İstanbul m3 ÉTÉ", 5), (4, "description", 0, None, None),
    ]
    probes = ["m3", "M3", "32 GB", "512GB", "aa", "(x)", "été", "", None, "istanbul"]
    s, p = frames(spark, segments, probes)
    assert set(map(tuple, P.scan(s, p).collect())) == plainly(segments, [x for x in probes if x != "istanbul"])


@pytest.mark.parametrize("together, block", [(1 << 20, 200_000), (64, 3), (700, 7)])
def test_long_sources_stream(spark, monkeypatch, together, block):
    """Texts many times as long as what is held; several blocks of probes."""
    monkeypatch.setattr(P, "TOGETHER", together)
    rng = random.Random(together)
    words = ["alpha", "beta", "rtx", "5070", "ti", "x", "16GB", "16", "GB", "RTX-5070"]
    probes = ["rtx 5070", "rtx 5070 ti", "16GB", "16 GB", "alpha beta alpha", "x", "ti x", "beta", "5070"]
    segments = [(k, "transcript", i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), i * 10) for k in range(6) for i in range(40)]
    s, p = frames(spark, segments, probes)
    scan = P._scanner(type("Sent", (), {"value": tuple(sorted(x.lower() for x in probes))})(), 50, 70, [P.pa.int64(), P.pa.string()])
    rows = s.orderBy("key", "source", "place", "text").where("text <> ''").select("key", "source", "text", "seconds").toArrow().to_batches()
    got = {tuple(r.values()) for b in scan(iter(rows)) for r in b.to_pylist()}
    assert {(*x[:2], x[2].lower(), *x[3:]) for x in plainly(segments, probes, most=50)} == got
    assert set(map(tuple, P.scan(s, p, block=block).collect())) == plainly(segments, probes)


def test_no_text_meets_a_probe_by_a_join(spark):
    s, p = frames(spark, [(1, "d", 0, "m3", None)], ["m3"])
    plan = P.scan(s, p)._jdf.queryExecution().optimizedPlan().toString()
    scan = plan[plan.index("MapInArrow") :]
    assert "Join" not in scan and "Generate" not in scan


def test_empty(spark):
    s, p = frames(spark, [(1, "d", 0, "m3", None)], ["m3"])
    assert P.scan(s.limit(0), p).count() == 0 and P.scan(s, p.limit(0)).count() == 0
    assert P.scan(s, p.limit(0)).columns == P.scan(s, p).columns == ["key", "source", "probe", "nth", "at", "matched", "context", "seconds"]


def test_probe_strings(spark):
    names = ["Intel Core Ultra 7 Processor 358H", "AMD Ryzen AI 5 430", "Intel Graphics", "NVIDIA GeForce RTX 5070 Ti", "Arc (B390)", "", None, "Core i7-1370P vPro"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(P.model_probes(df.n)).collect()] == [["358H"], ["AI 5 430"], [], ["RTX 5070 Ti"], ["B390"], [], [], ["i7-1370P"]]
    gb = spark.createDataFrame([(512,), (1024,), (1536,), (2048,)], "g int")
    assert [r[0] for r in gb.select(P.storage_probes(gb.g)).collect()] == [["512GB", "512 GB"], ["1024GB", "1024 GB", "1TB", "1 TB"], ["1536GB", "1536 GB"], ["2048GB", "2048 GB", "2TB", "2 TB"]]


def test_evidence_of_a_family(spark):
    members = spark.createDataFrame([(1, 10, "Core 358H", 16, 512), (2, 10, "Core 358H", 32, 512), (3, 10, None, 32, 512), (4, 20, "Core 999X", 8, 256)], "id bigint, family bigint, processor_model string, ram_gb int, ssd_gb int")
    reviews = spark.createDataFrame([(100, 10), (101, 10), (102, None), (103, 20), (104, 10)], "key bigint, family bigint")
    text = "the 358h with 32 GB or 512GB and a 999X"
    segments = spark.createDataFrame([(100, "description", 0, text, None), (101, "transcript", 0, "nothing", 0), (102, "description", 0, text, None), (103, "description", 0, text, None)], SEGMENTS)
    hits = P.evidence(reviews, segments, members)
    got = sorted((r["key"], r["column"], r["value"], r["probe"], r["matched"], list(r["members"])) for r in hits.collect())
    # storage is the same for all members, the other family has one member, and a null tells the processor apart
    assert got == [(100, "processor_model", "Core 358H", "358H", "358h", [1, 2]), (100, "ram_gb", "32", "32 GB", "32 GB", [2, 3])]
    asked = {r["key"]: tuple(r)[1:] for r in P.searched(reviews, segments, members, hits).collect()}
    assert asked == {100: (3, 5, 1, False), 101: (3, 5, 1, True), 102: (0, 0, 1, False), 103: (0, 0, 1, False), 104: (3, 5, 0, False)}
    assert hits.select(F.max("nth")).first()[0] == 1
