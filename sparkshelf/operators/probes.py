"""Which configuration does a source speak of? Strings that tell a family's members apart are looked for in descriptions and transcripts.

All probe strings go into one automaton (Aho-Corasick), which passes over each text once, whatever their number; texts are never copied for a
probe. Probes are broadcast in blocks of bounded size, one pass over the texts a block. A source may come as many segments: they are joined
by a space and streamed through the automaton in order, with as much of the text held as a hit and its context need."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkshelf.operators.windows import differing_columns

#: Words of part names that tell no part from another, hits a probe and source, characters around a hit.
NOISE = "intel core processor cpu gpu amd ryzen nvidia geforce graphics vpro radeon arc apple laptop with series edition mobile".split()
MOST, AROUND = 2, 70
#: Probes of one broadcast, and characters of a text that are searched together.
BLOCK, TOGETHER = 200_000, 1 << 20


def model_probes(name: Column) -> Column:
    """The part numbers of a name (letters and digits, three characters or more); without any, its last three words that say something, if they hold a
    digit and are five characters or more; else none."""
    words = F.filter(F.split(name, r"[\s,]+"), lambda w: (w != "") & ~F.lower(F.regexp_replace(w, r"^[()]+|[()]+$", "")).isin(*NOISE))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[()]+|[()]+$", ""))
    parts = F.filter(bare, lambda w: w.rlike(r"\p{N}") & w.rlike(r"\p{L}") & (F.length(w) >= 3))
    tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), 3), " ")
    none = F.array().cast("array<string>")
    return F.when(F.size(parts) > 0, parts).when((F.size(words) > 0) & tail.rlike(r"\p{N}") & (F.length(tail) >= 5), F.array(tail)).otherwise(none)


def ram_probes(gb: Column) -> Column:
    return F.array(F.concat(gb.cast("string"), F.lit("GB")), F.concat(gb.cast("string"), F.lit(" GB")))


def storage_probes(gb: Column) -> Column:
    """As memory; whole terabytes in both units."""
    tb = (gb / 1024).cast("bigint")
    return F.concat(ram_probes(gb), F.when((gb >= 1024) & (gb % 1024 == 0), F.array(F.concat(tb.cast("string"), F.lit("TB")), F.concat(tb.cast("string"), F.lit(" TB")))).otherwise(F.array().cast("array<string>")))


#: Which columns are looked for, and how.
BUILDERS: Mapping[str, Callable[[Column], Column]] = {"processor_model": model_probes, "gpu_model": model_probes, "ram_gb": ram_probes, "ssd_gb": storage_probes}


def lowered(text: str) -> str:
    """Lower case with every character at its place: those whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Source:
    """Hits of one source, fed segment by segment."""

    def __init__(self, automaton, longest: int, most: int, around: int):
        self.automaton, self.longest, self.most, self.around = automaton, longest, most, around
        self.text, self.base, self.settled = "", 0, 0  # text[0] stands at base; hits that end at settled or before are told
        self.waiting: list[str] = []
        self.held, self.length = 0, 0
        self.starts: list[int] = []
        self.seconds: list[int | None] = []
        self.seen: dict[str, tuple[int, int]] = {}  # probe -> hits so far, end of the last

    def feed(self, text: str, seconds: int | None) -> Iterator[tuple]:
        for a in range(0, len(text), TOGETHER):
            part = text[a : a + TOGETHER]
            if a == 0:
                gap = " " if self.length else ""
                self.starts.append(self.length + len(gap))
                self.seconds.append(seconds)
                part = gap + part
            self.waiting.append(part)
            self.held += len(part)
            self.length += len(part)
            if self.held >= TOGETHER:
                yield from self.search(False)

    def search(self, last: bool) -> Iterator[tuple]:
        """(probe, nth, at, matched, context, seconds) of the hits that have all they need behind them."""
        text = self.text = "".join([self.text, *self.waiting])
        self.waiting, self.held = [], 0
        limit = len(text) if last else max(0, len(text) - self.around - 1)
        for stop, (probe, left, right) in self.automaton.iter(lowered(text)):
            end, start = stop + 1, stop + 1 - len(probe)
            if end > limit or self.base + end <= self.settled:
                continue
            if left and start > 0 and word(text[start - 1]) or right and end < len(text) and word(text[end]):
                continue
            n, before = self.seen.get(probe, (0, 0))
            if n >= self.most or self.base + start < before:
                continue
            self.seen[probe] = n + 1, self.base + end
            at = self.base + start
            context = re.sub(r"\s+", " ", text[max(0, start - self.around) : end + self.around]).strip()
            segment = bisect_right(self.starts, at) - 1
            yield probe, n + 1, at, text[start:end], context, self.seconds[max(segment, 0)]
        self.settled = max(self.settled, self.base + limit)
        cut = max(0, limit - self.longest - self.around - 1)
        self.text, self.base = text[cut:], self.base + cut
        gone = max(0, bisect_right(self.starts, self.base) - 1)
        del self.starts[:gone], self.seconds[:gone]


@functools.lru_cache(1)
def _automaton(probes: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in probes:
        found.add_word(p, (p, p[0].isalnum(), p[-1].isalnum()))
    found.make_automaton()
    return found


HIT = "probe string, nth int, at bigint, matched string, context string, seconds bigint"


def _scanner(probes, most: int, around: int, kinds: list[pa.DataType]):
    names = ["key", "source", *(x.split()[0] for x in HIT.split(", "))]
    types = [*kinds, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, state, found = _automaton(probes.value), None, None, []
        longest = max(map(len, probes.value))
        for batch in batches:
            for key, source, text, seconds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if (key, source) != now or state is None:
                    if state is not None:
                        found += [(*now, *x) for x in state.search(True)]
                    now, state = (key, source), Source(automaton, longest, most, around)
                found += [(*now, *x) for x in state.feed(text.as_py(), seconds)]
                if len(found) >= 5000:
                    yield rows(found)
                    found = []
        if state is not None:
            found += [(*now, *x) for x in state.search(True)]
        yield rows(found)

    return scan


def scan(segments: DataFrame, probes: DataFrame, probe: str = "probe", most: int = MOST, around: int = AROUND, block: int = BLOCK) -> DataFrame:
    """(key, source, probe, nth, at, matched, context, seconds): the first ``most`` places of every probe in every source, in order and not
    overlapping one another, whatever the case; ``at`` counts characters from 0 in the source's joined text, ``seconds`` are those of the segment
    that the hit begins in, ``context`` has ``around`` characters on both sides with white space squeezed.

    segments: key, source, place (order inside a source), text, seconds. Where a probe begins or ends with a letter or digit,
    no letter, digit or underscore may stand beside it. Null and empty texts are skipped, as are null and empty probes; a source of any length is
    streamed; segments of one place go by their text; repeated segments are two; no segments or no probes give no rows. Other columns are not read."""
    key_type = segments.schema["key"].dataType
    kind = {"integer": pa.int32(), "long": pa.int64()}.get(key_type.typeName(), pa.string())
    key = F.col("key") if kind != pa.string() else F.col("key").cast("string")
    rows = segments.where("text <> ''").select(key.alias("key"), "source", "place", "text", F.col("seconds").cast("bigint").alias("seconds"))
    rows = rows.repartition("key", "source").sortWithinPartitions("key", "source", "place", "text").select("key", "source", "text", "seconds")
    lower = F.udf(lambda p: lowered(p), "string")
    each = probes.where(f"`{probe}` <> ''").select(F.col(probe).alias("__given"), lower(F.col(probe)).alias("probe")).distinct()
    distinct = each.select("probe").distinct()
    blocks = -(-distinct.count() // block)
    parts = []
    for i in range(blocks):
        some = tuple(sorted(r["probe"] for r in distinct.where(F.pmod(F.xxhash64("probe"), F.lit(blocks)) == i).toLocalIterator()))
        if some:
            sent = segments.sparkSession.sparkContext.broadcast(some)
            head = f"key {rows.schema['key'].dataType.simpleString()}, source string, "
            parts.append(rows.mapInArrow(_scanner(sent, most, around, [kind, pa.string()]), head + HIT))
    if not parts:
        nulls = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in HIT.split(", ")]
        return rows.select("key", "source", *nulls).limit(0)
    hits = reduce(DataFrame.union, parts)
    return hits.join(each, "probe").select("key", "source", F.col("__given").alias("probe"), "nth", "at", "matched", "context", "seconds")


def family_probes(members: DataFrame, builders: Mapping[str, Callable[[Column], Column]], family: str = "family", member: str = "id") -> DataFrame:
    """(family, column, value, members, probe): the probe strings of every value of the columns that differ inside a family, with the members that have
    it. Values without probes have one row with a null probe; null values have none."""
    columns = [c for c in builders if c in members.columns]
    differ = differing_columns(members, family, columns).withColumnRenamed("differing", "__differing")
    long = [members.select(F.col(family).alias("family"), F.col(member).alias("__id"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), builders[c](F.col(c)).alias("probes")) for c in columns]
    values = reduce(DataFrame.union, long).where("value is not null")
    values = values.join(differ.withColumnRenamed(family, "family"), "family").where(F.array_contains("__differing", F.col("column")))
    held = values.groupBy("family", "column", "value").agg(F.sort_array(F.collect_set("__id")).alias("members"), F.first("probes").alias("probes"))
    return held.select("family", "column", "value", "members", F.explode_outer(F.array_distinct("probes")).alias("probe"))


def evidence(reviews: DataFrame, segments: DataFrame, members: DataFrame, builders: Mapping[str, Callable[[Column], Column]] = BUILDERS, family: str = "family", member: str = "id", **how) -> DataFrame:
    """(key, family, source, column, value, probe, nth, matched, context, at, seconds, members): what the sources of each review say of the columns
    that tell its family's members apart. reviews: key and family; segments as in scan(). Reviews without a family have no hits."""
    wanted = family_probes(members, builders, family, member).where("probe is not null")
    met = scan(segments, wanted, **how).join(reviews.select("key", F.col(family).alias("family")), "key")
    out = met.join(wanted, ["family", "probe"])
    return out.select("key", "family", "source", "column", "value", "probe", "nth", "matched", "context", "at", "seconds", "members")


def searched(reviews: DataFrame, segments: DataFrame, members: DataFrame, hits: DataFrame, builders: Mapping[str, Callable[[Column], Column]] = BUILDERS, family: str = "family", member: str = "id") -> DataFrame:
    """(key, values, probes, sources, found_nothing) of every review: how many values and probe strings were looked for, in how many sources with a
    text, and whether that was all in vain; with nothing to search or nothing to look for it was not."""
    asked = family_probes(members, builders, family, member).groupBy("family").agg(F.count_distinct("column", "value").alias("values"), F.count("probe").alias("probes"))
    held = segments.where("text <> ''").groupBy("key").agg(F.count_distinct("source").alias("sources"))
    some = hits.groupBy("key").agg(F.count(F.lit(1)).alias("__hits"))
    out = reviews.select("key", F.col(family).alias("family")).join(asked, "family", "left").join(held, "key", "left").join(some, "key", "left").na.fill(0, ["values", "probes", "sources", "__hits"])
    return out.select("key", "values", "probes", "sources", ((F.col("__hits") == 0) & (F.col("sources") > 0) & (F.col("values") > 0)).alias("found_nothing"))
