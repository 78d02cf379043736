"""Phrase collocations by Apriori passes over the corpus, a level of phrase lengths a pass.

A pass reads every text, cuts it into pieces and words, and emits a k-gram only where both (k-1)-grams inside it are frequent in its language. The frequent
ones are broadcast as a bitmap of their hashes: Spark builds it (bitmap_construct_agg), its size is set by their number and
bounded by ``most_bits``, and it never says no to a frequent gram. What a full bitmap lets through besides is counted and falls
below the threshold, so results are the same at any size. Texts are worked on as byte arrays in numpy, cut where a piece ends; counts leave a task
summed by Spark's partial aggregation. Level tables are written to the shared folder; cuts and containment are joins of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

LEAST, LONGEST, TOP = 30, 4, 2000
#: Inside a longer candidate with this share (in percent) of its count, a phrase goes.
WITHIN = 80
#: Bytes of text that are worked on together, at about thirty times as much memory; cut where a piece ends.
TOGETHER = 2 << 20
MOST_BITS = 1 << 30
WORD, SPACE, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
LOW = np.arange(256, dtype=np.uint8)
LOW[ord("A") : ord("Z") + 1] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """The words of some texts: code (of the word in this slice), lang (code) and piece (number) of each, in order."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, langs: np.ndarray, names: list[str]):
        """starts: where texts begin in raw; langs: their codes; names: what the codes stand for."""
        kind = KIND[raw]
        inside = kind == WORD
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = starts[starts < len(raw)]
        begins[first] = inside[first]
        at = np.flatnonzero(begins)
        place = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(place[at] - 1, place[-1] if len(place) else 0).astype(np.int32)
        data = LOW[raw[inside]]
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        self.words, self.names = words.dictionary, names
        self.code = words.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(starts, at, "right") - 1
        self.lang = langs[text].astype(np.int64)
        self.piece = np.cumsum(kind == END, dtype=np.int32)[at] + text  # both only grow, so pieces of two texts differ
        self.n_words = len(self.words)

    def hashes(self, k: int) -> np.ndarray:
        """A hash of the k words from each place on, and their language."""
        one = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()), np.uint64, self.n_words)[self.code]
        n = len(one) - k + 1
        h = np.zeros(max(n, 0), np.uint64)
        for i in range(k if n > 0 else 0):
            h = h * STEP + one[i : i + n]
        names = np.fromiter((xxhash.xxh64_intdigest(x) for x in self.names), np.uint64, len(self.names))
        h = (h ^ (names[self.lang[:n]] if n > 0 else h)) * STEP
        return h ^ (h >> np.uint64(32))

    def counted(self, k: int, frequent: np.ndarray | None) -> pa.RecordBatch:
        """(lang, phrase, n) of the k-grams of this slice, those of whose (k-1)-grams one is surely not frequent left out. For k = 1 also a row
        of null phrase for each language with its number of words."""
        n = len(self.code) - k + 1
        if n <= 0:
            return _rows([], [], [])
        ok = self.piece[:n] == self.piece[k - 1 :]
        if frequent is not None:
            slot = self.hashes(k - 1) & np.uint64(8 * len(frequent) - 1)
            known = (frequent[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            ok &= (known[:-1] & known[1:]).astype(bool)
        at = np.flatnonzero(ok)
        key = self.lang[at]
        for i in range(k):
            key = key * self.n_words + self.code[at + i]
            if i % 2 or i == k - 1:  # two words more at most before keys are numbered anew, so they stay below 2^63
                _, where, key, n_of = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        at = at[where]
        parts = [self.words.take(pa.array(self.code[at + i])) for i in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
        langs = pa.array(self.names, pa.string()).take(pa.array(self.lang[at]))
        if k > 1:
            return _rows(langs, phrase, n_of)
        totals = np.bincount(self.lang)
        some = np.flatnonzero(totals)
        return _rows(pa.concat_arrays([langs, pa.array(self.names, pa.string()).take(pa.array(some))]), pa.concat_arrays([phrase, pa.nulls(len(some), pa.string())]), np.concatenate([n_of, totals[some]]))


def _rows(langs, phrases, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def _slices(texts: pa.Array, langs: pa.Array) -> Iterator[Grams]:
    """Slices of about TOGETHER bytes, cut between texts or after a piece; only one piece that is longer itself makes a longer slice."""
    texts, langs = pc.fill_null(texts.cast(pa.string()), ""), pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or edges[-1] == edges[0]:
        return
    raw, edges = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]
    a = 0
    while a < len(raw):
        b = len(raw) if len(raw) - a <= TOGETHER else a + TOGETHER
        if b < len(raw):
            near = np.flatnonzero(KIND[raw[a:b]] == END)
            cut = max(int(edges[np.searchsorted(edges, b, "right") - 1]), a + int(near[-1]) + 1 if len(near) else a)
            while cut <= a:  # a piece without end so far
                more = np.flatnonzero(KIND[raw[b : b + TOGETHER]] == END)
                cut = min(int(edges[np.searchsorted(edges, b, "left")]), b + int(more[0]) + 1 if len(more) else len(raw))
            b = cut
        low, high = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b, "left")
        yield Grams(raw[a:b], np.maximum(edges[low:high] - a, 0), codes[low:high], names)
        a = b


def _emit(k: int, frequent):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        for batch in batches:
            for slice_ in _slices(batch.column(1), batch.column(0)):
                yield slice_.counted(k, bits)

    return emit


def _slots(bits: int, k: int):
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            if not len(batch):
                continue
            text = batch.column(1)
            raw = np.frombuffer("".join(f"{p} " for p in text.to_pylist()).encode(), np.uint8)
            ends = np.cumsum(pc.binary_length(text).to_numpy() + 1)
            g = Grams(raw, np.concatenate([[0], ends[:-1]]), codes, names)
            yield pa.RecordBatch.from_arrays([pa.array((g.hashes(k)[::k] & np.uint64(bits - 1)).astype(np.int64))], ["slot"])

    return slots


def bitmap(level: DataFrame, k: int, n: int, most_bits: int = MOST_BITS) -> bytes:
    """Bits set at the hashes of a level's n phrases of k words: 16 bits a phrase or more, up to most_bits. Aggregated by Spark in blocks of 4 KB,
    so what reaches the driver is the bitmap, whatever the number of phrases."""
    bits = 1 << 15
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    slots = level.select("lang", "phrase").mapInArrow(_slots(bits, k), "slot bigint")
    block = F.bitmap_bucket_number(F.col("slot") + 1).alias("block")
    found = slots.groupBy(block).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    out = bytearray(bits // 8)
    for r in found.toLocalIterator():
        out[(r["block"] - 1) * 4096 : r["block"] * 4096] = r["bits"]
    return bytes(out)


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, most_bits: int = MOST_BITS) -> list[DataFrame]:
    """A written table (lang, phrase, f) for each number of words up to ``longest``: all phrases that occur at least ``least`` times
    in their language. The first also has a row of null phrase for each language with its number of words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        frequent = None
        if k > 1:
            known = found[-1].where("phrase is not null")
            frequent = spark.sparkContext.broadcast(bitmap(known, k - 1, known.count(), most_bits))
        counts = rows.mapInArrow(_emit(k, frequent), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found.append(written(counts.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}"))
        if frequent is not None:
            frequent.destroy()
    return found


def _part(first: int, n: int) -> F.Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words that stand together for themselves.

    a, l and r count the phrase and the two parts of its worst cut, n all words. Texts are lower-cased (A-Z) and split into pieces
    at ``. , ; : ! ?`` and line ends, pieces at spaces and tabs. Null texts are empty; a null language is ``und``, together with any of that name; a
    text of any length is read whole, some pieces at a time; ties of the score go by a, then by the phrase's bytes, those of cuts to
    the shorter first part; repeated rows count as often as they stand; an empty table gives none. Other columns are not read."""
    found = levels(docs, text, lang, least, longest, most_bits)
    known = reduce(DataFrame.union, found).where("phrase is not null")
    totals = found[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    each = [f.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), F.lit(k).alias("k")) for k, f in enumerate(found[1:], 2)]
    candidates = reduce(DataFrame.union, each)

    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"), "words", "k")
    cut = cut.select("lang", "phrase", "a", "at", _part(1, F.col("at")).alias("first"), _part(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    side = lambda part, count: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cut = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("c"))

    parts = [c.select("lang", "a", F.explode(F.array(*(_part(i, m) for m in range(2, k) for i in range(1, k - m + 2)))).alias("phrase")) for k, c in enumerate(each, 2) if k > 2]
    out = worst
    if parts:
        longer = reduce(DataFrame.union, parts).groupBy("lang", "phrase").agg(F.max("a").alias("of"))
        wide = lambda c: F.col(c).cast("decimal(19, 0)")
        out = worst.join(longer, ["lang", "phrase"], "left").where(F.col("of").isNull() | (wide("of") * 100 < wide("a") * WITHIN))
    w = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(totals, "lang")
    out = written(out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "c.l", "c.r", "n", F.col("c.score").alias("score")), "phrases")
    for f in found:
        drop_written(docs.sparkSession, f)
    return out


ORACLE = r"""WITH p AS (SELECT lang, doc_id, row_at, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS row_at, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents WHERE text <> '')),
w AS (SELECT lang, row_at, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT lang, row_at, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4 FROM w WINDOW s AS (PARTITION BY row_at, p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, 1 AS k, w1 AS phrase FROM g UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) FROM g WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM g WHERE w4 IS NOT NULL) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.k AS cut, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS score FROM c, (VALUES (1), (2), (3)) x(k), f l, f r WHERE x.k < c.k AND l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:x.k], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(c.ws[x.k + 1:], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) WHERE o = 1),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c, (SELECT lang, a AS of, unnest(CASE k WHEN 3 THEN [array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')] WHEN 4 THEN [array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' '), array_to_string(ws[3:4], ' '), array_to_string(ws[1:3], ' '), array_to_string(ws[2:4], ' ')] END) AS part FROM c WHERE k > 2) z WHERE z.lang = c.lang AND z.part = c.phrase AND 100 * CAST(z.of AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT)),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase))
SELECT k.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN n USING (lang) WHERE rank <= 2000"""
