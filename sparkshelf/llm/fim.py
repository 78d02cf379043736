"""Fill-in-middle: every text is cut into prefix, middle and suffix between units, and written in one of two orders.

The matcher passes over a text twice and keeps no list of units: the first pass counts them, the second advances a lazy iterator
of matches to the two ranks and notes where they end. Ranks and forms come from a hash of the document's id, so reruns agree. All else is
columns: the cuts alone come back from Python, and the output is put together by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of the contract: a line with its line end, or what is left of one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7


def cut_points(text: str, units: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """(n, prefix, middle): the number of units, and the code points of what ends after the smaller and between it and the larger of first % (n + 1)
    and second % (n + 1) units. Memory is that of one match whatever n is."""
    n = sum(1 for _ in units.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches, a = units.finditer(text), 0
    for m in islice(matches, low - 1 if low else 0, low):
        a = m.end()
    b = a
    for m in islice(matches, max(high - low - 1, 0), high - low):
        b = m.end()
    return n, a, b - a


def cuts(pattern: str):
    """A UDF (text, first, second) -> struct (n, prefix, middle) for a pattern of units that cover a text and are never empty."""
    units = re.compile(pattern)

    @F.arrow_udf("n long, prefix long, middle long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            found = [cut_points(t.as_py(), units, a, b) for t, a, b in zip(texts, first.to_pylist(), second.to_pylist())]  # one text is held at a time
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
            yield pa.StructArray.from_arrays(columns, ["n", "prefix", "middle"])

    return run


def _draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", units: str = LINES, rate: int = 100, spm_rate: int = 50, seed: int = SEED, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Per row of docs: id_col, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    A text stays plain if it is empty or holds one of the marks (so that restored() is exact), or by chance in all but ``rate`` of 100 cases;
    ``spm_rate`` of 100 others become spm. Null texts are empty; texts of any length take the memory of the text and its
    output; repeated rows each keep a row, with the same cuts, as the draw hangs on the id alone; equal ranks give an empty middle; a
    null id draws as an empty one; an empty table gives none. Other columns are not read."""
    h = _draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    rows = rows.withColumn("c", cuts(units)("t", "h1", "h2"))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains("t", F.lit(mark))
    plain = (F.col("t") == "") | held | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    p, m = F.col("c.prefix").cast("int"), F.col("c.middle").cast("int")
    prefix, middle, suffix = F.substring("t", F.lit(1), p), F.substring("t", p + 1, m), F.substring("t", p + m + 1, F.length("t"))
    a, b, c = map(F.lit, marks)
    output = F.when(F.col("form") == "psm", F.concat(a, prefix, b, suffix, c, middle)).when(F.col("form") == "spm", F.concat(b, suffix, a, prefix, c, middle)).otherwise(F.col("t"))
    cut = lambda x: F.when(F.col("form") != "plain", F.col(x))
    return rows.select(F.col("id").alias(id_col), F.col("c.n").alias("n"), "form", cut("c.prefix").alias("prefix_chars"), cut("c.middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text from an output and its form: exact, as no text with a mark in it is ever cut. Null gives null."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **how) -> DataFrame:
    """fill_in_middle() with hashes of the output and of the text restored from it in the output's place."""
    out = fill_in_middle(docs, **how)
    back = restored(F.col("output"), F.col("form"))
    return out.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(back, 256)).drop("output")


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
r AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(us[:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
