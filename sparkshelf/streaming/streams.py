"""Streaming forms: daily counts with a watermark, a sliding-window rate limit, resume by key, dead-job watch, versioned caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def daily(events: DataFrame, ts: str, measures: dict[str, Column], late: str = "1 day", zone_hours: int = 8) -> DataFrame:
    """(day, measures) by business day of a fixed offset; works on a batch and, with the watermark, on a stream."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, "1 day", startTime=f"{(24 - zone_hours) % 24} hours")
    out = events.groupBy(w.alias("w")).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.to_date(F.col("w.start") + F.expr(f"interval {zone_hours} hours")).alias("day"), *measures)


def tumbling(events: DataFrame, ts: str, every: str, late: str, *keys: str) -> DataFrame:
    """(start, keys, n) in tumbling windows."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[float | None], list[float]]:
    """For each hit in order: None if it is within the limit, else the seconds until the oldest counted hit leaves the window. A refused hit is
    not counted. Returns the answers and the hits still held."""
    answers: list[float | None] = []
    for now in times:
        while held and now - held[0] >= window:
            held = held[1:]
        if len(held) >= limit:
            answers.append(window - (now - held[0]))
        else:
            held = [*held, now]
            answers.append(None)
    return answers, held


def _limited(limit: int, window: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers rows that come sorted by key and time; holds one batch and the counted hits of the current key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), []
        for batch in batches:
            answers: list[float | None] = []
            for k, us in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist()):
                if k != current:
                    current, held = k, []
                one, held = admit([float("nan") if us is None else us / 1e6], held, limit, window)
                answers += one
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.float64())], [*batch.schema.names, "retry_after"])

    return run


class Limiter(StatefulProcessor):
    """Answers a key's hits as they arrive; its state is the counted hits of one window, and a timer that drops them."""

    def __init__(self, key: str, ts: str, limit: int, window: float):
        self.key, self.ts, self.limit, self.window = key, ts, limit, window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        held = [r[0] / 1e6 for r in self.held.get()] if self.held.exists() else []
        for row in rows:
            now = row["__us"] / 1e6
            answers, held = admit([max(now, held[-1]) if held else now], held, self.limit, self.window)
            yield Row(**{self.key: row[self.key], self.ts: row[self.ts], "retry_after": answers[0]})
        self.held.put([(round(t * 1e6),) for t in held])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((held[-1] + self.window) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.held.clear()  # whatever comes now is a window later than the last counted hit
        return iter(())

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, window: float, late: str = "10 minutes") -> DataFrame:
    """Per hit: key, ts, retry_after (null if admitted). A refused hit is not counted.

    A batch streams through its tasks in order of time, with the counted hits of one key held. A stream answers in order of arrival, one hit at a
    time however many a key has in a trigger; the clock of a key never goes back, so a hit from before the last counted one counts at that
    one's time. State is at most ``limit`` times a key (in RocksDB: set spark.sql.streaming.stateStore.providerClass), and goes once the watermark, ``late``
    behind the newest hit, is a window past the last one, where it could change no answer. On a stream hits of null or too late a time are dropped."""
    rows = events.select(key, F.col(ts).cast("timestamp").alias(ts))
    if not events.isStreaming:
        schema = f"`{key}` {dict(events.dtypes)[key]}, `{ts}` timestamp, retry_after double"
        return rows.repartition(key).sortWithinPartitions(F.col(key), F.asc_nulls_last(ts)).mapInArrow(_limited(limit, window), schema)
    rows = rows.where(F.col(ts).isNotNull()).withColumn("__us", F.unix_micros(ts)).withWatermark(ts, late)
    out = T.StructType([rows.schema[key], T.StructField(ts, T.TimestampType()), T.StructField("retry_after", T.DoubleType())])
    return rows.groupBy(key).transformWithState(Limiter(key, ts, limit, window), out, "Append", "EventTime")


class Expiring(StatefulProcessor):
    """A cache entry a key: a value that lives for one time, a failure that lives for another."""

    def __init__(self, key: str, value_ms: int, failure_ms: int):
        self.key, self.value_ms, self.failure_ms = key, value_ms, failure_ms

    def init(self, handle) -> None:
        self.value = handle.getValueState("value", "value string", ttlDurationMs=self.value_ms)
        self.failure = handle.getValueState("failure", "value string", ttlDurationMs=self.failure_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: r["kind"] == "ask"):  # what was found out in this trigger, before what is asked in it
            if row["kind"] == "value":
                self.value.update((row["value"],))
                self.failure.clear()
            elif row["kind"] == "failure":
                self.failure.update((row["value"],))
            else:
                hit, bad = self.value.exists(), self.failure.exists()
                found = self.value.get()[0] if hit else self.failure.get()[0] if bad else None
                yield Row(**{self.key: row[self.key], "answer": "hit" if hit else "failed" if bad else "miss", "value": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


def cached(lookups: DataFrame, key: str, value_seconds: float = 300.0, failure_seconds: float = 60.0) -> DataFrame:
    """(key, answer, value) of every ask of a stream (key, kind, value): ``hit`` with the value that was last told, for value_seconds after it was;
    ``failed`` with the reason for failure_seconds after a failure was told, unless a value is still held; else ``miss``.

    kind is ask, value or failure. Expiry is by the cluster's clock, in the state store (RocksDB); a restart goes on with what is held. Such a stream runs a batch
    at every trigger, so give it a processing-time trigger."""
    rows = lookups.select(key, "kind", F.col("value").cast("string").alias("value"))
    out = T.StructType([rows.schema[key], T.StructField("answer", T.StringType()), T.StructField("value", T.StringType())])
    return rows.groupBy(key).transformWithState(Expiring(key, int(value_seconds * 1000), int(failure_seconds * 1000)), out, "Append", "ProcessingTime")


def token_bucket(costs: list[float], per_minute: float) -> list[float]:
    """Start times of calls paced so that their tokens stay within a budget per minute."""
    out, at = [], 0.0
    for c in costs:
        out.append(at)
        at += c / per_minute * 60.0
    return out


AMOUNT = "decimal(28,6)"


def spent_in_window(usage: DataFrame, ts: str, tokens: str, seconds: int = 60, corrections: DataFrame | None = None, id_col: str | None = None, budget: float | None = None) -> DataFrame:
    """usage with ``spent``: the tokens of the rolling window that ends at each row, itself and others of its time included; with a budget also ``fits``:
    whether that is within it, or the row is alone.

    corrections (id_col, at, tokens; one a row): from ``at`` on, the row of that id counts with these tokens instead of its own, as long as it is in the window
    at all. Spending only changes at points: a row begins, is corrected, leaves. Points of one time are summed first, so those of a second are a bounded
    number; the running sum over them is taken within seconds, over the seconds of an hour, and over the hours. No task sees more than
    a second's points, whatever the number of rows. Amounts are exact to six decimals; rows of null time or tokens have null or spend nothing."""
    amount = lambda c: F.coalesce(F.col(c).cast(AMOUNT), F.lit(0).cast(AMOUNT))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width = seconds * 1_000_000
    rows = usage.select(us.alias("us"), amount(tokens).alias("n"), *([F.col(id_col).alias("__id")] if corrections is not None else [])).where("us is not null")
    if corrections is not None:
        told = corrections.select(F.col(id_col).alias("__id"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), amount("tokens").alias("real"))
        rows = rows.join(told, "__id", "left").withColumn("at", F.when(F.col("at").isNotNull(), F.greatest("at", "us")))
    else:
        rows = rows.withColumn("at", F.lit(None).cast("bigint")).withColumn("real", F.col("n"))
    late = F.col("at").isNull() | (F.col("at") >= F.col("us") + width)
    points = F.array(F.struct("us", F.col("n").alias("n")), F.when(~late, F.struct(F.col("at").alias("us"), (F.col("real") - F.col("n")).alias("n"))), F.struct((F.col("us") + width).alias("us"), F.when(late, -F.col("n")).otherwise(-F.col("real")).alias("n")))
    points = points.cast("array<struct<us:bigint,n:decimal(30,6)>>")
    changes = rows.select(F.explode(F.array_compact(points)).alias("p")).groupBy("p.us").agg(F.sum("p.n").alias("n"))
    second = lambda every: F.floor(F.col("us") / (every * 1_000_000)).cast("bigint")
    changes = changes.withColumn("__s", second(1)).withColumn("__h", second(3600))
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_second = changes.groupBy("__h", "__s").agg(F.sum("n").alias("n"))
    per_hour = per_second.groupBy("__h").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("decimal(38,6)")
    hours = per_hour.select("__h", F.coalesce(F.sum("n").over(before([], "__h")), zero).alias("__bh"))
    each = per_second.select("__h", "__s", F.coalesce(F.sum("n").over(before(["__h"], "__s")), zero).alias("__bs"))
    now = changes.select("us", "__s", F.sum("n").over(Window.partitionBy("__s").orderBy("us")).alias("__in"))
    at = now.join(each, "__s").join(hours, "__h").select(F.col("us").alias("__us"), (F.col("__in") + F.col("__bs") + F.col("__bh")).alias("spent"))
    out = usage.withColumn("__at", us).join(at, F.col("__at") == F.col("__us"), "left").drop("__at", "__us").withColumn("spent", F.col("spent").cast(AMOUNT))
    if budget is not None:
        out = out.withColumn("fits", (F.col("spent") <= budget) | (F.col("spent") == F.col(tokens).cast(AMOUNT)))
    return out


def resume(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose keys were not processed yet: for foreachBatch sinks that must stand a replay."""
    return batch.join(done.select(*keys).distinct(), keys, "left_anti")


def breaker(outcomes: list[bool], n: int) -> int | None:
    """After how many outcomes a run of n failures stops the work; None if it never does."""
    run = 0
    for i, ok in enumerate(outcomes, 1):
        run = 0 if ok else run + 1
        if run == n:
            return i
    return None


def dead_jobs(jobs: DataFrame, now: Column, hours: float = 6.0) -> DataFrame:
    """Jobs without an update for ``hours``, marked failed."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    live = F.col("status").isin("queued", "processing", "cancelling")
    return jobs.where(live & (idle > int(hours * 3_600_000_000))).withColumn("status", F.lit("failed")).withColumn("error", F.lit("no progress"))


class VersionedCache:
    """A computed table kept as long as the version of its sources stays the same; the old one serves while a new one is made elsewhere."""

    def __init__(self, version: Callable[[], str], build: Callable[[], DataFrame]):
        self.version, self.build = version, build
        self.held: tuple[str, DataFrame] | None = None

    def get(self) -> DataFrame:
        now = self.version()
        if self.held is None or self.held[0] != now:
            fresh = self.build().persist()
            if self.held is not None:
                self.held[1].unpersist()
            self.held = (now, fresh)
        return self.held[1]


#: The transitions of a work queue.
QUEUE = {"pending": ("scraped", "failed", "html_uploaded"), "failed": ("pending", "scraped"), "html_uploaded": ("scraped", "failed"), "scraped": ("pending",)}


def advance(targets: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """targets with the status that the latest event of each key allows; events that no transition allows change nothing."""
    last = events.groupBy(key).agg(F.max_by("to_status", "ts").alias("__to"))
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in QUEUE.items() for x in kv])
    ok = F.coalesce(F.array_contains(allowed[F.col("status")], F.col("__to")), F.lit(False))
    return targets.join(last, key, "left").withColumn("status", F.when(ok, F.col("__to")).otherwise(F.col("status"))).drop("__to")
