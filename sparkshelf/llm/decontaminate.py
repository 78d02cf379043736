"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ten consecutive words of an item (a shorter item is one window). Only exact containment counts, so of the
shingles of a window any single one is a sufficient prefix: the rarest over the benchmark, first in the window on a tie.
Documents look up their shingles among those prefixes; a match at a shingle's position fixes the only place where the window
can be (positional bound), which must lie inside the document (length bound); there the words are compared one by one.

Shingles have five words (fewer where the window has fewer) and stand for themselves as 64-bit hashes; a collision only
costs a comparison. The lookup happens inside each document's own array, against the prefixes as a literal set, so texts are
split once, never exploded by word and never shuffled; only matches, with the few words around them, become rows. The set
and the windows are broadcast while the benchmark has at most ``most_windows`` windows, which is counted first. Beyond that
all shingle positions are exploded and joined by shuffle, with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE, SHINGLE = 10, 5
MOST_WINDOWS = 50_000


def words(c: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(c, F.lit(""))), F.lit(WORDS), F.lit(0))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``w`` (words), ``n``, ``size`` (words in a shingle), ``items`` (sorted ids as strings), ``prefix`` (hash
    of the rarest shingle) and ``at`` (its place in the window). Items of null id or without words have no window."""
    each = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("all")).where("size(all) > 0")
    each = each.withColumn("n", F.least(F.size("all"), F.lit(SIZE)))
    each = each.select("item", F.explode(F.expr("transform(sequence(1, size(all) - n + 1), i -> slice(all, i, n))")).alias("w"))
    each = each.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    each = each.select("*", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"))
    cut = F.expr("transform(sequence(1, n - size + 1), i -> xxhash64(slice(w, i, size)))")
    spread = each.select("w", "n", "size", "items", F.posexplode(cut).alias("at", "prefix"))
    rarity = spread.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("seen"))
    best = spread.join(rarity, ["size", "prefix"]).groupBy("w", "n", "size", "items").agg(F.min(F.struct("seen", "at", "prefix")).alias("best"))
    return best.select("w", "n", "size", "items", F.col("best.prefix").alias("prefix"), F.col("best.at").alias("at"))


def _near(size: int, i: str) -> str:
    """A match as a struct: shingle size, position, hash, and the words that a window over it could hold, from position lo."""
    lo = f"greatest(0, {i} - {SIZE - size})"
    return f"struct({size} as size, {i} as i, xxhash64(slice(__w, {i} + 1, {size})) as h, {lo} as lo, slice(__w, {lo} + 1, {i} - {lo} + {SIZE}) as near)"


def candidates(docs: DataFrame, text: str, keyed: DataFrame, most_windows: int = MOST_WINDOWS) -> tuple[DataFrame, bool]:
    """docs with ``__n`` (words) and ``__c`` (matches with a prefix, or all positions if the benchmark is too large to broadcast),
    and whether it is small."""
    known = keyed.select("size", "prefix").limit(most_windows + 1).collect()
    small = len(known) <= most_windows
    sizes = [r["size"] for r in keyed.select("size").distinct().collect()] if not small else sorted({r["size"] for r in known})
    each = []
    for size in sizes:
        places = f"sequence(0, size(__w) - {size})"
        if small:
            listed = ",".join(f"{h}L" for h in sorted({r["prefix"] for r in known if r["size"] == size}))
            places = f"filter({places}, i -> xxhash64(slice(__w, i + 1, {size})) in ({listed}))"
        each.append(f"if(size(__w) < {size}, array(), transform({places}, i -> {_near(size, 'i')}))")
    kind = "array<struct<size:int,i:int,h:bigint,lo:int,near:array<string>>>"
    every = f"cast(concat({', '.join(each)}) as {kind})" if each else f"cast(array() as {kind})"
    split = docs.select("*", words(F.col(text)).alias("__w"))
    return split.select("*", F.size("__w").alias("__n"), F.expr(every).alias("__c")).drop("__w"), small


def verified(found: DataFrame, row: str, keyed: DataFrame, small: bool) -> DataFrame:
    """(row, start, n, items) of every window that does occur where a candidate puts it."""
    each = found.where("size(__c) > 0").select(row, "__n", F.explode("__c").alias("c")).select(row, "__n", "c.*")
    right = keyed.select(F.col("size").alias("__size"), "prefix", "at", "n", "w", "items")
    met = each.join(F.broadcast(right) if small else right, (F.col("h") == F.col("prefix")) & (F.col("size") == F.col("__size")))
    met = met.withColumn("start", F.col("i") - F.col("at")).where("start >= 0 and start + n <= __n")
    return met.where("slice(near, start - lo + 1, n) = w").select(row, "start", "n", "items")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit (words inside any occurrence of a window), n_items, ``items`` (sorted as strings),
    items_sha256 (of the items, comma-joined) and contaminated (n_hit > 0).

    Null or empty texts have no words; items of null id or no words are left out; repeated rows and null ids each keep a row;
    without documents there are no rows, without items no hits. Other columns are not read."""
    keyed = written(windows(items, item_id, item_text), "benchmark-windows")
    base = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    found, small = candidates(base, "__text", keyed, most_windows)
    if not small:  # rows must keep their number over two reads
        base = written(base.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-rows")
        found, _ = candidates(base, "__text", keyed, most_windows)
        found = found.drop("__text")
    else:
        found = written(found.drop("__text").withColumn("__row", F.monotonically_increasing_id()), "decontaminate-candidates")
    hit = verified(found, "__row", keyed, small).groupBy("__row").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("at"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    covered = "aggregate(at, struct(0 as hit, 0 as past), (a, x) -> struct(a.hit + greatest(0, x.start + x.n - greatest(a.past, x.start)) as hit, greatest(a.past, x.start + x.n) as past), a -> a.hit)"
    hit = hit.select("__row", F.expr(covered).cast("long").alias("n_hit"), "items")
    out = found.select("__row", "__id", "__n").join(hit, "__row", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("__id").alias(id_col), F.col("__n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), listed.alias("items"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of docs without any occurrence of a window, all columns. Rows without a candidate pass as they are; only the
    others meet the verified hits in a join."""
    keyed = written(windows(items, item_id, item_text), "benchmark-windows")
    packed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    if keyed.isEmpty():
        return docs
    found, small = candidates(packed, "__text", keyed, most_windows)
    if not small:
        packed = written(packed, "decontaminate-rows")
        found, _ = candidates(packed, "__text", keyed, most_windows)
        return packed.join(verified(found, "__row", keyed, small).select("__row").distinct(), "__row", "left_anti").select("__doc.*")
    found = written(found.drop("__text"), "decontaminate-candidates")
    bad = verified(found, "__row", keyed, small).select("__row").distinct()
    doubt = found.where("size(__c) > 0").join(bad, "__row", "left_anti")
    return found.where("size(__c) = 0").select("__doc.*").union(doubt.select("__doc.*"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(0, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 10)], ' '))) AS s FROM iw WHERE len(w) > 0
), spot AS (
  SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS p, w FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT doc_id, p, spot.n, item_id FROM spot JOIN win ON win.n = spot.n AND win.s = array_to_string(spot.w[p + 1 : p + spot.n], ' ')
), cov AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS js FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(js, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
