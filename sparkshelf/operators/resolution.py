"""Resolution of model strings to benchmark marks: exact forms first, similarity for the rest, once for each distinct string."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkshelf.functions import similarity
from sparkshelf.operators.joins import longest_contained
from sparkshelf.tables import settled

#: The least confidence of a match.
CPU_THRESHOLD, GPU_THRESHOLD = 0.90, 0.85
#: Strings that stand for no model.
PLACEHOLDERS = ("unknown", "n/a", "none", "-")
#: GPU names by core count, and the part whose mark stands in for each.
CORE_COUNT_EQUIVALENTS = {
    "40 core gpu": "GeForce RTX 5070 Ti Laptop GPU",
    "20 core gpu": "GeForce RTX 4060 Laptop GPU",
    "12 core gpu": "Intel Arc B390 GPU",
    "10 core gpu": "Qualcomm Adreno X2-90 GPU",
    "8 core gpu": "Intel Arc 140T GPU",
    "32 core gpu": "GeForce RTX 5070 Laptop GPU",
    "16 core gpu": "GeForce RTX 5050 Laptop GPU",
    "5 core gpu": "Intel UHD Graphics",
}
#: A bare name whose laptop row has another spelling; words that name only the maker.
VARIANT_OVERRIDES = {"geforce rtx 3050": "GeForce RTX 3050 4GB Laptop GPU"}
VENDORS = r"\b(nvidia|amd|intel)\b"
LAPTOP_SUFFIX = " laptop gpu"
DROPPED = "®™©℠⁰¹²³⁴⁵⁶⁷⁸⁹‘’“”"


#: Signs that join a number to what follows it: hyphen, non-breaking hyphen, en dash.
DASHES = "-\u2011\u2013"


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _dashes_dropped(words: Column) -> Column:
    """Words without the lone dashes inside a core count (``10 - core``) or a part number (``x1e - 78 - 100``)."""
    flat = lambda i: F.translate(F.get(words, i), f"{DASHES}()", "")
    like = lambda i, pattern: F.coalesce(flat(i).rlike(pattern), F.lit(False))
    lone = lambda i: F.coalesce(F.get(words, i).rlike(f"^[{DASHES}]+$"), F.lit(False))
    head, two, three = "^x[12][ep]?$", "^[0-9]{2}$", "^[0-9]{3}$"

    def stays(w: Column, i: Column) -> Column:
        count = like(i - 1, "^[0-9]+$") & like(i + 1, "^core$")
        begun = like(i - 1, head) & (like(i + 1, two) | like(i + 1, "^[0-9]{5}$")) | like(i - 1, "^x[12][ep]?[0-9]{2}$") & like(i + 1, three)
        going_on = like(i - 1, two) & like(i + 1, three) & (like(i - 2, head) | lone(i - 2) & like(i - 3, head))
        return ~(lone(i) & (count | begun | going_on))

    return F.filter(words, stays)


def _counted(words: Column) -> Column:
    """Core counts as two bare words, whether they came as ``(10-core)``, ``10-core``, ``10- core`` or ``(10 core)``."""
    bare = lambda w: F.translate(w, "()", "")
    number = lambda w: F.coalesce(bare(w).rlike(f"^[0-9]+[{DASHES}]?$"), F.lit(False))
    core = lambda w: F.coalesce(bare(w).rlike(f"^[{DASHES}]?core$"), F.lit(False))

    def one(w: Column, i: Column) -> Column:
        pair = number(w) & core(F.get(words, i + 1)) | core(w) & number(F.get(words, i - 1))
        return F.when(bare(w).rlike(f"^[0-9]+[{DASHES}]core$"), F.split(bare(w), f"[{DASHES}]")).otherwise(F.array(F.when(pair, F.translate(bare(w), DASHES, "")).otherwise(w)))

    return F.flatten(F.transform(words, one))


def _parts_joined(words: Column) -> Column:
    """Part numbers such as ``x1e-78-100`` or ``x1e 78 100`` as one word without dashes."""
    like = lambda i, pattern: F.coalesce(F.translate(F.get(words, i), DASHES, "").rlike(pattern), F.lit(False))
    head, two, five, three, most = "^x[12][ep]?$", "^[0-9]{2}$", "^[0-9]{5}$", "^[0-9]{3}$", "^x[12][ep]?[0-9]{2}$"

    def one(w: Column, i: Column) -> Column:
        flat = lambda n: F.translate(F.array_join(F.slice(words, i + 1, n), ""), DASHES, "")
        begins = F.when(like(i, "^x[12][ep]?[0-9]{5}$"), flat(1)).when(like(i, most) & like(i + 1, three) | like(i, head) & like(i + 1, five), flat(2)).when(like(i, head) & like(i + 1, two) & like(i + 2, three), flat(3))
        goes_on = like(i - 1, most) & like(i, three) | like(i - 1, head) & like(i, five) | like(i - 1, head) & like(i, two) & like(i + 1, three) | like(i - 2, head) & like(i - 1, two) & like(i, three)
        return F.when(goes_on, F.lit(None)).otherwise(F.coalesce(begins, w))

    return F.array_compact(F.transform(words, one))


def _without_frame(words: Column) -> Column:
    """``arm apple ... 0 mhz`` without its first word and its last two."""
    framed = (F.get(words, F.lit(0)) == "arm") & (F.get(words, F.lit(1)) == "apple")
    n = F.size(words)
    clock = F.coalesce((F.get(words, n - 2) == "0") & (F.get(words, n - 1) == "mhz") & (n > 3), F.lit(False))
    return F.when(F.coalesce(framed, F.lit(False)), F.slice(words, 2, n - 1 - F.when(clock, 2).otherwise(0))).otherwise(words)


def normal_name(c: Column) -> Column:
    """Canonical form of a part name, word by word: marks dropped, compatibility forms decomposed (only where there is any other than
    ASCII), lower case, the word ``processor`` dropped, core counts as ``N core``, part numbers in one word, single spaces. Applying it
    twice changes nothing. Null stays null."""
    s = F.translate(c, DROPPED, "")
    s = F.lower(F.when(s.rlike(r"[^\x00-\x7F]"), _decomposed(s)).otherwise(s))
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}_])processor(?![\p{L}\p{N}_])", " ")
    words = F.filter(F.split(F.replace(s, F.lit("("), F.lit(" (")), r"\s+"), lambda w: w != "")
    out = _let(words, lambda w: _let(_counted(_dashes_dropped(w)), lambda x: _let(_parts_joined(x), lambda y: F.array_join(_without_frame(y), " "))))
    return F.when(c.isNotNull(), F.coalesce(out, F.lit("")))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("", *PLACEHOLDERS), F.lit(True))


def has_anchor(c: Column) -> Column:
    """Some token of three characters or more has a digit."""
    tokens = F.split(F.translate(normal_name(F.coalesce(c, F.lit(""))), "-", " "), " ")
    return F.exists(tokens, lambda t: (F.length(t) >= 3) & t.rlike("[0-9]"))


def variant_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, VENDORS, " "), r"\s+", " "))


PART_NUMBER = r"\b(x[12][ep]?\d{5})\b"


#: References in a block, strings in a chunk, and references that are sent to all tasks at most; more meet the chunks in a join.
BLOCK, TOGETHER, MOST_SENT = 4096, 16, 50_000
MEASURES = {"token_set": similarity.token_set_ratio, "weighted": similarity.weighted_ratio}


def _packed(texts: DataFrame, each: int, n: int | None) -> tuple[DataFrame, int, int]:
    """(part, texts): distinct texts in parts of about ``each`` by hash; how many parts and texts there are. n: about how many, if known."""
    n = texts.count() if n is None else n
    parts = max(1, -(-n // each))
    return texts.groupBy(F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int").alias("part")).agg(F.sort_array(F.collect_list("t")).alias("ts")), parts, n


def searched(left: DataFrame, text: str, right: DataFrame, ref: str, measure: str, k: int = 1, below: bool = False, least: float | None = None, sizes: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(text, ref, score) of distinct texts against distinct references: those of the k best scores of each block of references with ties (with
    below, also of the next lower score), or, with least, all at or above it. Scores of 0 give no row.

    Both sides are packed: a chunk of texts meets each block of references once, so a reference is sent per chunk, not per text, and
    neither side has a size limit."""
    chunks, n_chunks, _ = _packed(left.select(F.col(text).alias("t")).where("t is not null").distinct(), TOGETHER, sizes[0])
    blocks, n_blocks, n = _packed(right.select(F.col(ref).alias("t")).where("t <> ''").distinct(), BLOCK, sizes[1])
    asked = chunks.select("ts", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part")).repartition(min(4096, n_chunks * n_blocks))
    blocks = blocks.withColumnRenamed("ts", "refs")
    met = asked.join(F.broadcast(blocks) if n <= MOST_SENT else blocks, "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = MEASURES[measure], None
        for batch in batches:
            for i in range(len(batch)):
                if part != batch.column("part")[i].as_py():
                    part = batch.column("part")[i].as_py()
                    refs = similarity.References(batch.column("refs")[i].as_py())
                rows = []
                for t in batch.column("ts")[i].as_py():
                    found = refs.over(t, of, least) if least is not None else refs.best(t, of, k, below)
                    rows += [(t, refs.texts[j], s) for s, j in found]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.string(), pa.float64()))], ["text", "ref", "score"])

    return met.select("part", "ts", "refs").mapInArrow(search, "text string, ref string, score double")


def _reference(marks: DataFrame) -> DataFrame:
    """ref (canonical name), matched, mark, part; of names that are one in canonical form, the greatest."""
    ref = marks.select(F.col("name").alias("matched"), "mark", normal_name(F.col("name")).alias("ref")).groupBy("ref").agg(F.max_by(F.struct("matched", "mark"), "matched").alias("m")).select("ref", "m.*")
    return ref.withColumn("part", F.regexp_extract("ref", PART_NUMBER, 1))


def _keyed(strings: DataFrame, name: str) -> DataFrame:
    """name, key and part of distinct strings that stand for a model."""
    d = strings.select(F.col(name).alias("name")).distinct().where(~is_placeholder(F.col("name")))
    return d.withColumn("key", normal_name(F.col("name"))).withColumn("part", F.regexp_extract("key", PART_NUMBER, 1))


def resolve(strings: DataFrame, name: str, marks: DataFrame, threshold: float = CPU_THRESHOLD) -> DataFrame:
    """(name, mark, matched, confidence) for every distinct name of strings; mark is null below the threshold.

    marks: name, mark, a reference list of any size. Names that equal a reference name in canonical form, or share its part
    number, never reach the search; of the rest, each distinct canonical form is searched for once. Ties: the lesser reference name."""
    d = strings.select(F.col(name).alias("name")).distinct()
    ref, known = settled(_reference(marks), "references"), settled(_keyed(strings, name), "names")  # distinct names, which every branch reads
    shared = known.where("part <> ''").join(ref.where("part <> ''"), "part").select("name", F.struct((-similarity.w_ratio("key", "ref")).alias("s"), "ref", "mark", "matched").alias("by_part"))
    equal = ref.select(F.col("ref").alias("key"), F.struct("mark", "matched").alias("equal"))
    main = known.join(shared.groupBy("name").agg(F.min("by_part").alias("by_part")), "name", "left").join(equal, "key", "left")
    rest = main.where("by_part is null and equal is null").select("key").distinct()
    top = searched(rest, "key", ref, "ref", "weighted", sizes=(known.count(), ref.count())).groupBy("text").agg(F.max(F.struct("score")).alias("s"), F.collect_list(F.struct("score", "ref")).alias("found"))
    first = F.array_min(F.transform(F.filter("found", lambda x: x["score"] == F.col("s.score")), lambda x: x["ref"]))
    top = top.select(F.col("text").alias("key"), first.alias("ref"), (F.col("s.score") / 100).alias("near")).join(ref.select("ref", F.struct("mark", "matched").alias("like")), "ref").select("key", "near", "like")
    found = main.join(top, "key", "left")
    pick = lambda c: F.when(F.col("by_part").isNotNull(), F.col(f"by_part.{c}")).when(F.col("equal").isNotNull(), F.col(f"equal.{c}")).otherwise(F.col(f"like.{c}"))
    confidence = F.when(F.col("by_part").isNotNull() | F.col("equal").isNotNull(), F.lit(1.0)).otherwise(F.col("near"))
    found = found.select(F.col("name").alias("__found"), pick("mark").alias("mark"), pick("matched").alias("matched"), confidence.alias("confidence"))
    ok = F.col("confidence") >= threshold
    out = d.join(found, F.col("name").eqNullSafe(F.col("__found")), "left").select("name", F.when(ok, F.col("mark")).alias("mark"), F.when(ok, F.col("matched")).alias("matched"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return out.withColumnRenamed("name", name)


def _ladder(pairs: DataFrame, gpu: str, cpu: str, marks: DataFrame, integrated: DataFrame) -> DataFrame:
    """(gpu, cpu, __i, how, __name) for every distinct pair: the names to try, in order. No name at all: one row of nulls."""
    d = pairs.select(gpu, cpu).distinct().withColumn("__anchor", has_anchor(F.col(gpu))).withColumn("__key", normal_name(F.coalesce(F.col(gpu), F.lit(""))))
    laptop = marks.withColumn("__n", normal_name(F.col("name"))).where(F.col("__n").endswith(LAPTOP_SUFFIX))
    laptop = laptop.select(variant_key(F.expr(f"left(__n, length(__n) - {len(LAPTOP_SUFFIX)})")).alias("__vk"), F.col("name").alias("__variant")).groupBy("__vk").agg(F.min("__variant").alias("__variant"))
    fixed = F.create_map(*[F.lit(x) for kv in VARIANT_OVERRIDES.items() for x in kv])
    equal = F.create_map(*[F.lit(x) for kv in CORE_COUNT_EQUIVALENTS.items() for x in kv])
    d = d.withColumn("__vk", variant_key(F.col("__key"))).join(laptop, "__vk", "left")
    keys = integrated.select(normal_name(F.col("cpu")).alias("__ck"), F.col("gpu").alias("__igpu"))
    own = longest_contained(d.select(normal_name(F.coalesce(F.col(cpu), F.lit(""))).alias("__cpu_key")), "__cpu_key", keys, "__ck", "__igpu")
    d = d.withColumn("__cpu_key", normal_name(F.coalesce(F.col(cpu), F.lit("")))).join(own, "__cpu_key", "left")
    variant = F.when(~F.col("__key").contains("laptop gpu"), F.coalesce(fixed[F.col("__vk")], F.col("__variant")))
    tries = F.when(F.col("__anchor"), F.array(F.when(variant.isNotNull(), F.struct(F.lit("laptop_variant").alias("how"), variant.alias("name"))).otherwise(F.struct(F.lit("direct").alias("how"), F.col(gpu).alias("name")))))
    tries = tries.otherwise(F.array_compact(F.array(
        F.when(equal[F.translate("__key", "-\u2011\u2013", "   ")].isNotNull(), F.struct(F.lit("apple_equivalent").alias("how"), equal[F.translate("__key", "-\u2011\u2013", "   ")].alias("name"))),
        F.when(F.col("__igpu").isNotNull(), F.struct(F.lit("integrated").alias("how"), F.col("__igpu").alias("name"))))))
    return d.select(gpu, cpu, F.posexplode_outer(tries).alias("__i", "__try")).select(gpu, cpu, "__i", "__try.how", F.col("__try.name").alias("__name"))


def resolve_gpu(pairs: DataFrame, gpu: str, cpu: str, marks: DataFrame, integrated: DataFrame) -> DataFrame:
    """(gpu, cpu, gpu_mark, gpu_resolution, gpu_is_proxy) for every distinct pair. integrated: cpu, gpu, the graphics built into CPUs.

    A name with a model number is direct, or the laptop row of the same part if it does not say laptop itself; else a core count's stand-in;
    else the graphics of the CPU (longest matching CPU name); else unresolved."""
    each = settled(_ladder(pairs, gpu, cpu, marks, integrated), "ladder")
    got = resolve(each.where("__name is not null"), "__name", marks, GPU_THRESHOLD)
    best = each.join(got, "__name", "left").groupBy(gpu, cpu).agg(F.min(F.when(F.col("mark").isNotNull(), F.struct("__i", "how", "mark"))).alias("b"))
    how = F.coalesce("b.how", F.lit("unresolved"))
    return best.select(gpu, cpu, F.col("b.mark").alias("gpu_mark"), how.alias("gpu_resolution"), (~how.isin("direct", "laptop_variant")).alias("gpu_is_proxy"))


def closest(strings: DataFrame, name: str, marks: DataFrame, threshold: float = CPU_THRESHOLD, k: int = 3) -> DataFrame:
    """What the matcher weighed: (name, kind, message, threshold, place, matched, mark, confidence), up to k rows of the nearest references
    of each distinct name, best first (the lesser reference on a tie).

    kind: ``placeholder`` (one row without candidate), ``qualcomm_part`` (only references of the same part number, confidence 1),
    ``qualcomm_part_missing`` (no reference has the part number; the nearest of all follow) or ``fuzzy``."""
    ref, known = settled(_reference(marks), "references"), settled(_keyed(strings, name), "names")
    has = ref.where("part <> ''").select("part").distinct().withColumn("has", F.lit(True))
    known = known.join(has, "part", "left").withColumn("kind", F.when(F.col("has"), "qualcomm_part").when(F.col("part") != "", "qualcomm_part_missing").otherwise("fuzzy"))
    same = known.where("has").join(ref, "part").select("name", "kind", "part", "ref", similarity.w_ratio("key", "ref").alias("score"), F.lit(1.0).alias("confidence"))
    free = known.where("has is null")
    near = searched(free, "key", ref, "ref", "weighted", k=k)
    near = free.join(near, free["key"] == near["text"]).select("name", "kind", "part", "ref", "score", F.round(F.col("score") / 100, 3).alias("confidence"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "ref")
    ranked = same.unionByName(near).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(ref.drop("part"), "ref")
    message = F.when(F.col("kind") == "qualcomm_part_missing", F.concat(F.lit("Exact part number "), F.upper("part"), F.lit(": no row carries it")))
    out = ranked.select("name", "kind", message.alias("message"), "place", "matched", "mark", "confidence")
    none = strings.select(F.col(name).alias("name")).distinct().where(is_placeholder(F.col("name"))).select("name", F.lit("placeholder").alias("kind"), F.lit("Placeholder, not a part name").alias("message"))
    return out.unionByName(none, allowMissingColumns=True).withColumn("threshold", F.lit(threshold)).withColumnRenamed("name", name)


def closest_gpu(pairs: DataFrame, gpu: str, cpu: str, marks: DataFrame, integrated: DataFrame, k: int = 3) -> DataFrame:
    """closest() along the ladder of resolve_gpu: for each distinct pair the nearest references of the first name that it would try. A GPU without
    any (no model number, no stand-in, no graphics known for its CPU) is of kind ``no_igpu_entry``."""
    first = _ladder(pairs, gpu, cpu, marks, integrated).where("__i is null or __i = 0")
    found = closest(first.where("__name is not null"), "__name", marks, GPU_THRESHOLD, k)
    out = first.join(found, "__name", "left")
    kind = F.when(F.col("__name").isNull(), "no_igpu_entry").otherwise(F.col("kind"))
    message = F.when(F.col("__name").isNull(), F.concat(F.lit("No integrated-GPU entry for CPU "), F.coalesce(F.nullif(F.col(cpu), F.lit("")), F.lit("unknown")))).otherwise(F.col("message"))
    return out.select(gpu, cpu, kind.alias("kind"), message.alias("message"), "place", "matched", "mark", "confidence", F.lit(GPU_THRESHOLD).alias("threshold"))


def best_fuzzy(left: DataFrame, text: str, right: DataFrame, key: str, threshold: float) -> DataFrame:
    """(text, matched, score, gap, tied) for each distinct text: the best key by token-set ratio (the lesser key on a tie) if it reaches the
    threshold, else null; the distance to the next lower score above 0 and how many keys share the best. No key that scores: 0 and 0."""
    found = searched(left, text, right, key, "token_set", below=True).groupBy("text").agg(F.collect_list(F.struct("score", "ref")).alias("f"))
    top = F.array_max(F.transform("f", lambda x: x["score"]))
    at = F.transform(F.filter("f", lambda x: x["score"] == F.col("score")), lambda x: x["ref"])
    lower = F.array_max(F.transform(F.filter("f", lambda x: x["score"] < F.col("score")), lambda x: x["score"]))
    found = found.withColumn("score", top).select("text", "score", F.array_min(at).alias("matched"), (F.col("score") - lower).alias("gap"), F.size(at).alias("tied"))
    d = left.select(F.col(text).alias("text")).where("text is not null").distinct()
    out = d.join(found, "text", "left").select(F.col("text").alias(text), F.when(F.col("score") >= threshold, F.col("matched")).alias("matched"), F.coalesce("score", F.lit(0.0)).alias("score"), "gap", F.coalesce("tied", F.lit(0)).alias("tied"))
    return out


def similar_pairs(names: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, score): unordered pairs of distinct keys with a token-set ratio at or above the threshold (above 0)."""
    met = searched(names, key, names, key, "token_set", least=threshold)
    return met.where("text < ref").select(F.col("text").alias("a"), F.col("ref").alias("b"), "score")


def match_key(c: Column) -> Column:
    """A product title without parentheses and unit words, single spaces, lower case."""
    s = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(gb|tb|ssd|inch|laptop|notebook)\b", " "), r"\s+", " "))
