"""Stateful streams: limiter and expiring cache, with restarts; rolling budgets; percentiles."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import aggregates as A
from sparkshelf.streaming import streams as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(out, name, checkpoint, clock=False):
    """One run over what is new. A stream with a clock of its own has a batch at every trigger, so it never ends by itself: it gets one."""
    how = {"processingTime": "1 hour"} if clock else {"availableNow": True}
    q = out.writeStream.format("parquet").option("path", f"{checkpoint}-out").outputMode("append").option("checkpointLocation", checkpoint).trigger(**how).start()
    until = time.time() + 60
    while q.isActive and time.time() < until and not (clock and any(p["numInputRows"] for p in q.recentProgress)):
        time.sleep(0.1)
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert time.time() < until
    return progress[-1]["stateOperators"][0]["numRowsTotal"] if progress else 0


def test_limiter_restarts_and_forgets(spark, tmp_path):
    schema = "k string, ts timestamp"
    src, cp = f"{tmp_path}/in", f"{tmp_path}/cp"
    hits = [0, 1, 2, 3, 10, 61, 62, 63, 64]
    at = lambda s: T0 + timedelta(seconds=s)
    stream = lambda: S.rate_limit(spark.readStream.schema(schema).parquet(src), "k", "ts", 3, 60.0, "30 seconds")
    add(spark, src, [("u", at(s)) for s in hits[:4]] + [("idle", at(0))], schema)
    run(stream(), "l", cp)
    add(spark, src, [("u", at(s)) for s in hits[4:]], schema)  # after a restart from the checkpoint
    kept = run(stream(), "l", cp)
    add(spark, src, [("z", at(5000))], schema)
    run(stream(), "l", cp)
    add(spark, src, [("z", at(5001))], schema)  # the watermark has passed all others by now
    left = run(stream(), "l", cp)
    assert left < kept
    got = {(r["k"], round((r["ts"].replace(tzinfo=timezone.utc) - T0).total_seconds())): r["retry_after"] for r in spark.read.parquet(f"{cp}-out").collect()}
    want = dict(zip([("u", s) for s in hits], S.admit([float(s) for s in hits], [], 3, 60.0)[0]))
    assert {k: v for k, v in got.items() if k[0] == "u"} == pytest.approx(want) and len(got) == len(hits) + 3


def test_limiter_answers_a_hot_key_row_by_row():
    """The processor itself: rows are taken one at a time, whatever their number."""
    from pyspark.sql import Row

    class State:
        rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    class Handle:
        timers = []

        def getListState(self, *a):  # noqa: N802
            return State()

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

        def deleteTimer(self, t):  # noqa: N802
            self.timers.remove(t)

        def registerTimer(self, t):  # noqa: N802
            self.timers.append(t)

    p = S.Limiter("k", "ts", 3, 60.0)
    p.init(Handle())
    taken = []

    def rows():
        for i in range(100_000):
            taken.append(i)
            yield Row(k="hot", ts=None, __us=i * 1_000_000)

    out = p.handleInputRows(("hot",), rows(), None)
    for i in range(5):
        next(out)
        assert len(taken) == i + 1
    answers = [r["retry_after"] for r in out]
    assert answers == S.admit([float(i) for i in range(100_000)], [], 3, 60.0)[0][5:] and len(p.held.rows) <= 3 and len(p.handle.timers) == 1
    late = list(p.handleInputRows(("hot",), iter([Row(k="hot", ts=None, __us=0)]), None))
    assert late[0]["retry_after"] is not None  # counted at the time of the last hit, not before it


def test_cache_entries_expire(spark, tmp_path):
    schema = "k string, kind string, value string"
    src, cp = f"{tmp_path}/in", f"{tmp_path}/cp"
    stream = lambda: S.cached(spark.readStream.schema(schema).parquet(src), "k", 600.0, 0.5)
    add(spark, src, [("a", "ask", None), ("b", "value", "v1"), ("b", "ask", None), ("c", "failure", "quota"), ("c", "ask", None)], schema)
    run(stream(), "c", cp, True)
    time.sleep(1.0)
    add(spark, src, [("a", "ask", None), ("b", "ask", "later"), ("c", "ask", "later")], schema)  # after a restart; the failure has expired, the value has not
    run(stream(), "c", cp, True)
    add(spark, src, [("c", "failure", "again"), ("c", "value", "v2"), ("c", "ask", None), ("b", "value", "v3"), ("b", "ask", None)], schema)
    run(stream(), "c", cp, True)
    want = [("a", "miss", None), ("b", "hit", "v1"), ("c", "failed", "quota"), ("a", "miss", None), ("b", "hit", "v1"), ("c", "miss", None), ("c", "hit", "v2"), ("b", "hit", "v3")]
    assert sorted(map(str, map(tuple, spark.read.parquet(f"{cp}-out").collect()))) == sorted(map(str, want))


def test_values_expire(spark, tmp_path):
    schema = "k string, kind string, value string"
    src, cp = f"{tmp_path}/in", f"{tmp_path}/cp"
    stream = lambda: S.cached(spark.readStream.schema(schema).parquet(src), "k", 0.5, 600.0)
    add(spark, src, [("a", "value", "v"), ("b", "failure", "f")], schema)
    run(stream(), "v", cp, True)
    time.sleep(1.0)
    add(spark, src, [("a", "ask", None), ("b", "ask", None)], schema)
    run(stream(), "v", cp, True)
    assert sorted(map(str, map(tuple, spark.read.parquet(f"{cp}-out").collect()))) == sorted(map(str, [("a", "miss", None), ("b", "failed", "f")]))


@pytest.mark.parametrize("seconds", [1, 60, 4000])
def test_rolling_budget_equals_brute_force(spark, seconds):
    rng = random.Random(seconds)
    rows = [(i, T0 + timedelta(microseconds=rng.choice([rng.randrange(9_000_000_000), rng.randrange(9000) * 1_000_000, 3_600_000_000])), rng.randrange(1, 900) / 8) for i in range(250)]
    told = [(i, at + timedelta(seconds=rng.choice([-5, 0, rng.random() * 2 * seconds, seconds])), float(rng.randrange(500))) for i, at, _ in rows if i % 3]
    df = spark.createDataFrame(rows, "id int, ts timestamp, n double")
    fixes = spark.createDataFrame(told, "id int, at timestamp, tokens double")
    real = {i: (at, n) for i, at, n in told}
    width = timedelta(seconds=seconds)

    def spent(t, corrected):
        total = 0.0
        for i, at, n in rows:
            if t - width < at <= t:
                fixed = corrected and i in real and max(real[i][0], at) <= t
                total += real[i][1] if fixed else n
        return total

    for corrected in (False, True):
        out = S.spent_in_window(df, "ts", "n", seconds, fixes if corrected else None, "id", budget=900.0)
        for r in out.collect():
            at, n = next((a, n) for i, a, n in rows if i == r["id"])
            want = spent(at, corrected)
            assert float(r["spent"]) == pytest.approx(want, abs=1e-6) and r["fits"] == (want <= 900 or abs(want - n) < 1e-9)


def test_rolling_budget_nulls_and_plan(spark):
    df = spark.createDataFrame([(1, T0, None), (2, None, 5.0), (3, T0, 2.0)], "id int, ts timestamp, n double")
    out = S.spent_in_window(df, "ts", "n")
    assert {r["id"]: None if r["spent"] is None else float(r["spent"]) for r in out.collect()} == {1: 2.0, 2: None, 3: 2.0}
    assert S.spent_in_window(df.limit(0), "ts", "n").count() == 0


@pytest.mark.parametrize("kind", ["spread", "close", "ties", "one", "wide"])
def test_percentiles_equal_sparks(spark, kind, monkeypatch):
    monkeypatch.setattr(A, "FEW", 7)
    monkeypatch.setattr(A, "CELLS", 5)
    rng = random.Random(kind)
    make = {"spread": lambda: rng.gauss(0, 100), "close": lambda: 1e6 + rng.random() * 1e-6, "ties": lambda: float(rng.randrange(4)), "one": lambda: 3.5, "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308)}[kind]
    rows = [(make(),) for _ in range(301)] + [(None,)]
    df = spark.createDataFrame(rows, "v double")
    fractions = (0.0, 0.05, 0.1, 0.5, 0.9, 0.95, 1.0)
    want = df.agg(F.percentile("v", F.array(*map(F.lit, fractions)))).first()[0]
    assert A.exact_percentiles(df, "v", fractions) == pytest.approx(want, rel=1e-12)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert A.exact_percentiles(df, "v", (0.1, 0.9)) == [None, None] and tuple(A.percentile_spread(df, "v").first()) == (None, None, None)
    assert A.exact_percentiles(spark.createDataFrame([(2.0,)], "v double"), "v", (0.3,)) == [2.0]
