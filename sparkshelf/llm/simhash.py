"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: a bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a text's three-word shingles.
Fingerprints link at ``most`` = 2 or fewer differing bits. Linking works on distinct fingerprints, so exact copies cost one
row whatever their number.

Pigeonring: a 64-bit fingerprint is a ring of three segments of 22, 21 and 21 bits. If two fingerprints differ in at most two
bits, some segment starts a chain in which every prefix of length l differs in at most l * 2 / 3 bits: the first segment in
none, the first two in at most one, all three in at most two. The join keys take both conditions together: a segment whole, plus
one half of the next segment, of which at least one is equal if the two differ in one bit at most. That is six keys of 31 bits or
more for a fingerprint: a bucket holds the distinct fingerprints of the corpus divided by 2^31 by chance (about one at two thousand million of them), besides
those that are alike.

A bucket of more than ``hot`` members (a large group of near copies) is never paired. Its members go another exact way:
fingerprints link iff some value lies within one bit of both, so each emits itself and its 64 one-bit neighbours, and all that
meet at a value link to the least of them: 65 rows for a member, never a pair of members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written
from .components import components

SEED = 42
#: First bit and length of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash; 0 for a null text or one without words."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_ = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > len(h)
    return int.from_bytes(np.packbits(set_).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))  # one text is held at a time


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(fp: Column, i: int) -> Column:
    start, n = SEGMENTS[i]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << n) - 1))


def ring_keys(fp: Column) -> Column:
    """Six keys: a segment whole (up to 22 bits) and a half of the next one (up to 11), tagged with which they are."""
    keys = []
    for i in range(3):
        after = _segment(fp, (i + 1) % 3)
        for j, half in enumerate((after.bitwiseAND(F.lit(1023)), F.shiftright(after, 10))):
            keys.append(F.lit((i * 2 + j) << 40).bitwiseOR(F.shiftleft(_segment(fp, i), 12)).bitwiseOR(half))
    return F.array(*keys)


def _chain(key: Column, a: Column, b: Column) -> Column:
    """The chain of two segments that begins at the key's own differs in at most one bit (the first not at all: the key)."""
    which = F.shiftright(key, 41)
    diff = a.bitwiseXOR(b)
    return F.bit_count(F.when(which == 0, _segment(diff, 1)).when(which == 1, _segment(diff, 2)).otherwise(_segment(diff, 0))) <= 1


def links(fps: DataFrame, fp: str = "fp", most: int = 2, hot: int = 48) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that connect exactly those within ``most`` (2) bits of each other,
    directly or, in hot buckets, over a common least neighbour that is itself within two bits of each. fps: one row for a value."""
    if most != 2:
        raise ValueError("the ring is laid out for two differing bits")
    keyed = fps.select(F.col(fp).alias("v"), F.explode(ring_keys(F.col(fp))).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keyed.join(sizes, "k"), "simhash-buckets")
    few = met.where(F.col("n") <= hot).groupBy("k").agg(F.collect_list("v").alias("vs"))
    pairs = few.select("k", "vs", F.explode("vs").alias("a")).select("k", "a", F.explode("vs").alias("b")).where("a < b")
    pairs = pairs.where(_chain(F.col("k"), F.col("a"), F.col("b"))).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    many = met.where(F.col("n") > hot).select("v").distinct()
    flips = F.concat(F.array(F.col("v")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    star = many.select("v", F.explode(flips).alias("c"))
    least = star.groupBy("c").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "m")
    starred = star.join(least, "c").where("v <> m").select("v", "m").distinct()
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(starred).distinct()


def simhash_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hot: int = 48) -> DataFrame:
    """Per row of docs: id_col, ``fp`` (bigint), ``fingerprint`` (16 hex digits), ``component_id``: the least id reachable over
    links of two or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. Null ids take part in links but are never a
    component's name, unless all its ids are null; repeated rows each keep a row; an empty table gives none. Other columns
    are not read."""
    facts = written(docs.select(id_col, fingerprints(F.col(text)).alias("fp")), "simhash-fingerprints")
    least = facts.groupBy("fp").agg(F.min(id_col).alias("first"))
    comp = written(components(links(least, hot=hot)), "simhash-components")
    named = comp.join(least.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    of = least.join(comp, least["fp"] == comp["node"], "left").join(named, "component", "left")
    of = of.select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return facts.join(of, "fp").select(id_col, "fp", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stand for their group: those of the least id. A row goes by its id and fingerprint together, so an unlike text under the id of
    a near copy stays. Repeated rows of the least id stay as they are (they are one document), as do rows of null id and all columns; null and empty texts
    are near copies of one another; texts are read whole; an empty table stays empty."""
    groups = simhash_groups(docs, text, id_col)
    own, name, value = (fresh(docs, c) for c in ("own_fp", "gone_id", "gone_fp"))
    gone = groups.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias(name), F.col("fp").alias(value)).distinct()
    rows = docs.withColumn(own, fingerprints(F.col(text)))
    return rows.join(gone, (rows[id_col] == F.col(name)) & (rows[own] == F.col(value)), "left_anti").select(*docs.columns)
