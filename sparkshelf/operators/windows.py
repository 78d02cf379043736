"""Window operators: latest rows, group representatives, percentiles, consecutive pairs, running totals, greedy windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given total order. Spark prunes each task to one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _group(group: str) -> Column:
    return F.col(group)


def dedup_first(ranked: DataFrame, group: str, rank: str) -> DataFrame:
    """Keeps the first row of each group by rank; rows of null group all stay."""
    known = ranked.where(F.col(group).isNotNull())
    return latest_per_key(known, [group], F.col(rank).asc()).unionByName(ranked.where(F.col(group).isNull()))


def dedup_closest(ranked: DataFrame, group: str, rank: str, value: str, goal: float) -> DataFrame:
    """One row a group: the member whose value is closest to goal (the earlier on a tie), placed at the first member's rank (column ``place``)."""
    known = ranked.where(F.col(group).isNotNull())
    w = Window.partitionBy(group)
    one = known.withColumn("place", F.min(rank).over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.abs(F.col(value) - goal).asc_nulls_last(), rank)))
    return one.where("__n = 1").drop("__n").unionByName(ranked.where(F.col(group).isNull()).withColumn("place", F.col(rank)))


def midpoint_percentile(df: DataFrame, value: str, out: str = "percentile", partition: list[str] | None = None, inverse: bool = False) -> DataFrame:
    """(rows below + half of the equal ones) / rows * 100 among non-null values; null for null.

    Counts distinct values first, so the running sum is over values, never over rows; with ``partition`` it runs in each part.
    Without, it runs over value buckets: the running sum inside a bucket plus the sums of the buckets before it."""
    keys = partition or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__eq"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(value)
        ranked = counts.withColumn("__to", F.sum("__eq").over(w)).withColumn("__all", F.sum("__eq").over(Window.partitionBy(*keys)))
    else:
        ranked = running_over_ranges(counts, value, "__eq", "__to").join(F.broadcast(counts.agg(F.sum("__eq").alias("__all"))))
    score = (F.col("__to") - F.col("__eq") / 2.0) / F.col("__all") * 100.0
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    ranked = ranked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), (100.0 - score if inverse else score).alias(out))
    on = F.col(value) == F.col("__v")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranked, on, "left").drop("__v", *[f"__k{i}" for i in range(len(keys))])


def range_of(value: Column) -> Column:
    """Number of the range that a number lies in: ranges of equal ratio, in ascending order, each a thousandth of a doubling. A plain
    function of the value, so it is the same wherever a plan computes it, however partitions are dealt or coalesced."""
    v = value.cast("double")
    place = lambda x: F.floor(F.log2(x) * 1000).cast("bigint") + 2_000_000
    return F.when(v > 0, place(v)).when(v < 0, -place(-v)).when(v == 0, F.lit(0).cast("bigint")).otherwise(F.lit(4_000_000).cast("bigint"))


def running_over_ranges(df: DataFrame, by: str, amount: str, out: str) -> DataFrame:
    """df with the sum of amount over all rows of a lesser or equal ``by`` (distinct numbers), without one task that sees all rows: rows are
    dealt by range_of, summed inside each range, and the totals of the ranges, which do not grow with the rows, are added up."""
    within = df.withColumn("__p", range_of(F.col(by))).withColumn("__in", F.sum(amount).over(Window.partitionBy("__p").orderBy(by)))
    totals = df.groupBy(range_of(F.col(by)).alias("__p")).agg(F.sum(amount).alias("__t"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.select("__p", "__before"), "__p").withColumn(out, F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")


def bisect_percentile(values: Column, x: Column, inverse: bool = False) -> Column:
    """Percentile of a value that need not be in the distribution; values: an array. Null gives 50; an empty array too."""
    below, equal = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (below + equal / 2.0) / F.size(values) * 100.0))
    return F.when(x.isNull() | (F.size(values) < 1), 50.0).otherwise(100.0 - score if inverse else score)


def consecutive(df: DataFrame, keys: list[str], order: list[str], value: str, ts: str) -> DataFrame:
    """Adds prev_value, prev_ts, ``jump`` (change of 30 % or more), ``rapid`` (a change within 24 hours) and ``zero``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("prev_value", F.lag(value).over(w)).withColumn("prev_ts", F.lag(ts).over(w))
    change = F.abs(F.col(value) - F.col("prev_value")) / F.col("prev_value")
    near = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp")) <= 86_400_000_000
    return out.withColumns({
        "jump": F.coalesce((F.col("prev_value") > 0) & (change >= 0.3), F.lit(False)),
        "rapid": F.coalesce((F.col("prev_value") != F.col(value)) & near, F.lit(False)),
        "zero": F.coalesce(F.col(value) == 0, F.lit(False)),
    })


def cap_per_group(df: DataFrame, group: str, per_group: int, total: int, *order: Column) -> DataFrame:
    """At most per_group rows of a group, total in all, in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_group).drop("__n").orderBy(*order).limit(total)


def surplus(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows after the first of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n > 1").drop("__n")


def running_total(daily: DataFrame, day: str, amount: str, opening: Column | None = None) -> DataFrame:
    """Cumulative amount by day; one row a day, so a single ordered window is small."""
    w = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("total", F.sum(amount).over(w) + (opening if opening is not None else F.lit(0)))


def greedy_windows(segments: Column, least: float = 45.0) -> Column:
    """Consecutive segments (array of text, start, duration) gathered until their durations reach ``least``; the last, shorter window stays. Gives an
    array of (text, start, duration), by a fold over the array."""
    kind = "struct<done:array<struct<text:string,start:double,duration:double>>,text:string,start:double,duration:double>"
    zero = F.expr(f"cast(named_struct('done', array(), 'text', null, 'start', null, 'duration', 0d) as {kind})")
    one = "struct<text:string,start:double,duration:double>"

    def step(a: Column, s: Column) -> Column:
        text = F.concat_ws(" ", a["text"], s["text"])
        start = F.coalesce(a["start"], s["start"].cast("double"))
        total = a["duration"] + s["duration"].cast("double")
        closed = F.struct(text.alias("text"), start.alias("start"), total.alias("duration")).cast(one)
        shut = F.struct(F.concat(a["done"], F.array(closed)).alias("done"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("start"), F.lit(0.0).alias("duration"))
        open_ = F.struct(a["done"].alias("done"), text.alias("text"), start.alias("start"), total.alias("duration"))
        return F.when(total >= least, shut.cast(kind)).otherwise(open_.cast(kind))

    def finish(a: Column) -> Column:
        rest = F.struct(a["text"].alias("text"), a["start"].alias("start"), a["duration"].alias("duration")).cast(one)
        return F.when(a["text"].isNotNull(), F.concat(a["done"], F.array(rest))).otherwise(a["done"])

    return F.aggregate(segments, zero, step, finish)


def previous_tail(keys: list[str], order: str, text: str, n: int = 300) -> Column:
    """The last n characters of the previous row's text; empty for the first."""
    return F.coalesce(F.right(F.lag(text).over(Window.partitionBy(*keys).orderBy(order)), F.lit(n)), F.lit(""))


def indistinguishable(df: DataFrame, signature: list[str]) -> DataFrame:
    """Adds ``alike``: another row has the same values (nulls equal) in all signature columns."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*signature))
    return df.withColumn("alike", n > 1)


def differing_columns(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, differing): the columns with two or more values inside a group, null counting as one; in the order given."""
    counts = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"__{c}") for c in columns]
    named = [F.when(F.col(f"__{c}") > 1, F.lit(c)) for c in columns]
    return df.groupBy(group).agg(*counts).select(group, F.array_compact(F.array(*named)).alias("differing"))


def last_official(history: DataFrame, key: str, price: str, ts: str, official: Column) -> DataFrame:
    """(key, price, ts) of the newest official row with a price above zero."""
    ok = official & (F.col(price) > 0)
    best = F.max(F.when(ok, F.struct(F.col(ts).alias("ts"), F.col(price).alias("price"))))
    return history.groupBy(key).agg(best.alias("b")).select(key, F.col("b.price").alias("price"), F.col("b.ts").alias("ts"))


def top_entries(entries: Column, by: str, n: int) -> Column:
    """The n array elements of greatest ``by``; ties keep their order in the array."""
    placed = F.transform(entries, lambda e, i: F.struct((-e[by]).alias("by"), i.alias("at"), e.alias("entry")))
    return F.slice(F.transform(F.array_sort(placed), lambda p: p["entry"]), 1, n)


def within_of_best(df: DataFrame, score: str, margin: float, partition: list[str]) -> DataFrame:
    return df.withColumn("__m", F.max(score).over(Window.partitionBy(*partition))).where(F.col(score) >= F.col("__m") - margin).drop("__m")
