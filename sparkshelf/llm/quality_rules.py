"""Quality rules combined by weak supervision.

Every rule votes keep (1), reject (0) or abstains (-1) on a document. Expectation-maximisation over the counted vote
patterns estimates each rule's accuracy and the share of good documents without any label, and a document's posterior
probability of being good replaces the usual demand that it pass all rules. Votes of a document are one of at most
3 ** 8 patterns, so what reaches the driver is bounded whatever the corpus holds: one pass measures the documents (plain
Python inside Arrow batches), one partial aggregation counts patterns, and the posteriors go back as a broadcast table of
patterns.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, fresh, written

SYMBOLS = "#*$%&|<>"
LOWER_BYTES = b"abcdefghijklmnopqrstuvwxyz"

MEASURES = T.StructType(
    [
        T.StructField(n, T.LongType())
        for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_distinct", "n_bangs")
    ]
)

#: In the order of votes().
RULES = ("symbols_a_word", "symbols_a_character", "shouting", "duplicate_lines", "repeated_words", "word_length", "length", "variety")


def repeated(words: list) -> tuple[int, int]:
    """How many words lie in a window of three that the text holds twice or more, and how many distinct words there are."""
    ids: defaultdict = defaultdict(itertools.count().__next__)
    at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    m = len(ids)
    if len(at) < 3:
        return 0, m
    two = at[:-2] * m + at[1:-1]
    if m >= 2_000_000:  # else a window of three does not fit into 63 bits
        two = np.unique(two, return_inverse=True)[1]
    key = two * m + at[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, m
    place = np.searchsorted(twice, key)
    hit = twice[np.minimum(place, len(twice) - 1)] == key
    cover = np.zeros(len(at), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum()), m


def measure(text: str | None) -> tuple:
    """The measures of one text; a null or empty text has none of anything."""
    if not text:
        return (0,) * 10
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    n_repeat, n_distinct = repeated(words)
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, LOWER_BYTES.upper()))
    lower = sum(map(str.islower, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, LOWER_BYTES))
    return (
        len(words), len(text) - sum(map(text.count, ASCII_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        n_repeat, len(lines), capitals, capitals + lower, n_distinct, text.count("!!"),
    )


@F.arrow_udf(MEASURES)
def measures(texts: pa.Array) -> pa.Array:
    found = list(zip(*(measure(t.as_py()) for t in texts))) or [()] * len(MEASURES)  # one text is held at a time
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], names=MEASURES.names)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> list[Column]:
    """One column a rule: 1 keep, 0 reject, -1 abstain. A text without words is rejected by its length alone."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def vote(value: Column, bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, -1).when(bad, 0).when(good, 1).otherwise(-1).cast("int")

    def defect(bad: Column) -> Column:
        return F.when(F.col("n_words") == 0, -1).when(bad, 0).otherwise(-1).cast("int")

    per_word = F.col("n_symbols") / n
    per_char = F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    caps = F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1))
    cased = 2 * F.col("n_letters") >= F.col("word_chars")  # else a script without capitals, numbers or signs: no word on shouting
    length = F.col("word_chars") / n
    return [
        vote(per_word, per_word > 0.2, per_word < 0.02),
        vote(per_char, per_char > 0.05, per_char < 0.005),
        vote(caps, cased & (caps > 0.6) | (F.col("n_bangs") / n > 0.2), cased & (caps < 0.3)),
        defect(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) > 0.4),
        defect(F.col("n_repeat_words") / n > 0.4),
        defect((length > 14) | (length < 2)),
        F.when(F.col("n_words") < 20, 0).when(F.col("n_words") >= 100, 1).otherwise(-1).cast("int"),
        defect(F.col("n_distinct") / F.sqrt(n) < 1.5),
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.8, floors: tuple = (0.2, 0.9)) -> tuple[np.ndarray, dict]:
    """Posterior probability of good for every vote pattern (rows of -1, 0, 1), by EM on a naive-Bayes vote model: given the
    true class, rules vote independently; whether a rule abstains says nothing. A rule may miss most bad documents, since
    each looks for one defect, but seldom rejects a good one; these starting points also fix which class is which. floors:
    the least accuracy that a rule is given on bad and on good documents. Empty input: none."""
    k = patterns.shape[1] if patterns.size else 0
    right = np.array([np.full(k, 0.5), np.full(k, 0.97)])  # probability of a correct vote, for bad and good documents
    share, post, total = prior, np.zeros(len(patterns)), max(counts.sum(), 1.0)
    for _ in range(rounds if len(patterns) else 0):
        good = np.log(share) + np.where(patterns == 1, np.log(right[1]), np.where(patterns == 0, np.log1p(-right[1]), 0)).sum(1)
        bad = np.log1p(-share) + np.where(patterns == 0, np.log(right[0]), np.where(patterns == 1, np.log1p(-right[0]), 0)).sum(1)
        post = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        w1, w0 = counts * post, counts * (1 - post)
        share = float(np.clip(w1.sum() / total, 0.05, 0.95))
        for c, w, low in ((1, w1, floors[1]), (0, w0, floors[0])):
            said = (w[:, None] * (patterns >= 0)).sum(0)
            ok = (w[:, None] * (patterns == c)).sum(0)
            right[c] = np.clip((ok + 4) / (said + 5), low, 0.999)
    return post, {"share": share, "right_bad": right[0].tolist(), "right_good": right[1].tolist()}


def posteriors(facts: DataFrame) -> DataFrame:
    """votes (an array) -> p_good, estimated from all rows of facts; at most 3 ** 8 rows."""
    seen = facts.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    seen.sort(key=lambda r: tuple(r["votes"]))
    post, _ = estimate(np.array([r["votes"] for r in seen]).reshape(len(seen), len(RULES)), np.array([r["n"] for r in seen], float))
    rows = [(list(map(int, r["votes"])), float(p)) for r, p in zip(seen, post)]
    return facts.sparkSession.createDataFrame(rows, "votes array<int>, p_good double")


def quality_rules(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per row of docs: id_col, the measures, ``votes``, ``p_good``, ``base_failed`` and ``kept``.

    kept is false where base_failed, else true if the posterior is at least the threshold. Null texts count as empty and
    are not kept; texts of any length are measured whole; repeated rows and null ids each get a row of their own; a posterior that ties
    with the threshold keeps; an empty table gives an empty one. Other columns of docs are not read."""
    facts = docs.select(F.col(id_col), measures(F.col(text)).alias("m")).select(id_col, "m.*")
    facts = written(facts.select("*", F.array(*votes()).alias("votes")), "quality-measures")
    out = facts.join(F.broadcast(posteriors(facts)), "votes", "left").withColumn("base_failed", base_failed())
    return out.select(*facts.columns, "p_good", "base_failed", (~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns. Measures every text twice, once to count vote
    patterns and once to filter, which costs less than a shuffle of the texts to join verdicts back. Null and empty texts go; texts of
    any length count whole; repeated rows share a verdict; an empty table stays empty; all columns are kept as they are."""
    facts = docs.select(measures(F.col(text)).alias("m")).select("m.*").select(F.array(*votes()).alias("votes"))
    table = posteriors(facts).where(F.col("p_good") >= threshold).select("votes")
    m, row = fresh(docs, "m"), fresh(docs, "row")
    once = measures.asNondeterministic()  # else the filter and the votes each measure every text again
    judged = docs.select(F.struct(*docs.columns).alias(row), once(F.col(text)).alias(m)).select(row, f"{m}.*")
    judged = judged.where(~base_failed()).select(row, F.array(*votes()).alias("votes"))
    return judged.join(F.broadcast(table), "votes", "left_semi").select(f"{row}.*")
