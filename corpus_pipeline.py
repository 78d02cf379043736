"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents, extra columns included, with the values that they came with. Nulls: a null text is an empty one (rejected by the
quality rules), a null doc_id is a document of its own that near-duplicates keep, a null source is a source. Texts of any length are
worked on whole; repeated rows share a fate; ties go by doc_id or by a hash of id and text; an empty table gives empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkshelf.llm.common import drop_written, table, written
from sparkshelf.llm.decontaminate import keep_clean
from sparkshelf.llm.mixing import mixed
from sparkshelf.llm.quality_rules import keep_good
from sparkshelf.llm.simhash import keep_one
from sparkshelf.llm.token_files import tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least a half."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs, F.array("source"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum in the token files."""
    return tokens(docs)


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", token_output)]

#: The stages need iterative models and a range coder, which SQL can't express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's rows are written to the shared folder and read by the next, after which they go; those of the
    last but one stay until the token files are read."""
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if docs is not source:
            drop_written(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
