"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. A ledger records, for each (blob, rule version) pair ever
scanned, what was found; a run scans only pairs that the ledger lacks, and findings are joined back to all paths and versions
that hold the blob. The ledger is partitioned by rule version.

Hashes go first: distinct ones meet those of the ledger, and texts are asked for by what is left. Up to MOST_UNSEEN unseen
hashes are broadcast (counted first), and texts are scanned where they are read, once in each task: no text moves, seen or unseen. More of
them meet the texts in a join that Spark shuffles; a first run, where all is unseen, needs no join at all."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Kind, pattern, the group that is measured, its least length. Matches that are too short are consumed and dropped.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Unseen hashes that are broadcast, at about 100 bytes each; hashes that a task keeps to pass over repeats, at about 100 bytes each.
MOST_UNSEEN, REMEMBERED = 20_000, 200_000
EMPTY = hashlib.sha256(b"").hexdigest()
LEDGER = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def rule_version(rules: tuple = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _compiled(rules: tuple) -> list[tuple]:
    """A rule that is one class of characters looks for long runs only: the same matches, without stopping at each short run."""
    out = []
    for kind, pattern, group, least in rules:
        if group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
            pattern = f"{pattern[:-1]}{{{least},}}"
        out.append((kind, re.compile(pattern), group, least))
    return out


def find(text: str, compiled: list[tuple]) -> list[tuple[int, int, int]]:
    """(start, place of the rule, end) of every kept match, in that order; code points, end exclusive."""
    found = []
    for k, (_, pattern, group, least) in enumerate(compiled):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def _scanner(rules: tuple):
    version = rule_version(rules)
    kinds = [r[0] for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, seen = _compiled(rules), set()
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (short := bytes.fromhex(key)) in seen:
                    continue
                if len(seen) >= REMEMBERED:  # only to save work: a repeat gives the same row again, which is dropped below
                    seen.clear()
                seen.add(short)
                found = find(text.as_py() or "", compiled)
                spans = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)
                counts = [sum(kinds[k] == kind for _, k, _ in found) for kind in ("assign", "access", "hex")]
                rows.append((key, version, *counts, hashlib.sha256(spans.encode()).hexdigest(), spans))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return scan


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_unseen(history: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple = RULES, most_unseen: int = MOST_UNSEEN) -> DataFrame:
    """Ledger rows for the blobs of history that ledger lacks under this rule version, each once."""
    texts = history.select(blob_of(F.col(text)).alias("blob"), F.col(text).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob")
        unseen = written(texts.select("blob").distinct().join(known, "blob", "left_anti"), "unseen-blobs")
        texts = texts.join(F.broadcast(unseen) if unseen.count() <= most_unseen else unseen, "blob", "left_semi")
    return texts.mapInArrow(_scanner(rules), LEDGER).dropDuplicates(["blob"])


def open_ledger(spark, path: str) -> DataFrame | None:
    """The ledger at path, or None before the first run."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def drafts(docs: DataFrame, text: str = "text") -> DataFrame:
    """A history to begin with: each text as it was before its last line was written; texts of one line have not changed since."""
    return docs.withColumn(text, F.regexp_replace(F.col(text), r"\n[^\n]*\z", ""))


def scan_secrets(history: DataFrame, text: str = "text", id_col: str = "doc_id", ledger_path: str | None = None, rules: tuple = RULES) -> DataFrame:
    """Per row of history: id_col, ``blob`` (SHA-256 of the text), counts of assign, access and hex, base_sha256 and spans.

    New findings are appended to the ledger at ledger_path (a fresh one in the shared folder if None), so a second run over
    the same texts and rules scans nothing. A run that dies half-way may leave rows in the ledger; they are whole rows of
    scanned blobs and stay right, and repeats of a pair are read once. Null texts are empty ones and hold nothing; texts of any length
    are scanned whole; of matches that begin together the order of the rules decides; repeated rows and null ids each keep a row; an
    empty history gives no rows. Other columns are not read."""
    spark = history.sparkSession
    version = rule_version(rules)
    if ledger_path is None:
        ledger = written(scan_unseen(history, text, None, rules), "secret-ledger")
    else:
        scan_unseen(history, text, open_ledger(spark, ledger_path), rules).write.mode("append").partitionBy("rule_version").parquet(ledger_path)
        ledger = open_ledger(spark, ledger_path).where(F.col("rule_version") == version).dropDuplicates(["blob"])
    seen = history.select(F.col(id_col).alias("__id"), blob_of(F.col(text)).alias("blob"))
    found = ledger.where("spans <> ''").drop("rule_version")
    out = seen.join(found, "blob", "left")
    n = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return out.select(F.col("__id").alias(id_col), *n, F.coalesce("base_sha256", F.lit(EMPTY)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), "blob")
