"""The queries of this subpackage, one for each numbered operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, fixity, phrases, pseudo_lm, url_filter
from .common import shared_dir, table
from .mixing import mix
from .quality_rules import quality_rules
from .secrets_scan import drafts, scan_secrets, scan_unseen
from .simhash import simhash_groups
from .token_files import tokens
from .wrapper import extract


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; the trees are trained on the pages' own URLs with seed labels by host words."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = pages.select("url", url_filter.seed_label(url_filter.host_of(F.col("url"))).alias("bad"))
    return url_filter.judge(pages, url_filter.train(labelled))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files, as read back from them."""
    return tokens(table(spark, sf_dir, "documents"))


def op3_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages"))


def op4_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's masked pseudo-log-likelihood under a network trained on all of them and the contexts of all others."""
    docs = table(spark, sf_dir, "documents")
    return pseudo_lm.score(docs, *pseudo_lm.fit(docs), contexts=pseudo_lm.CONTEXTS)


def op8_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in an archive and whether a replica with planted damage still holds it."""
    out = fixity.drill(table(spark, sf_dir, "pages"))
    return out.withColumn("page_id", F.col("key").cast("bigint")).drop("key")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, as the second run over a history: a first run scans the earlier versions into a ledger, this one scans the
    texts that the ledger lacks and joins findings to all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    scan_unseen(drafts(docs)).write.partitionBy("rule_version").parquet(ledger)
    return scan_secrets(docs, ledger_path=ledger).drop("blob")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside ten-word windows of the benchmark, and the items that these come from."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, base verdict and weak-supervision verdict."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, "p_good")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the least doc_id of its group."""
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, with its source's size and target."""
    docs = table(spark, sf_dir, "documents")
    out, shares = mix(docs, F.array("source"))
    out = out.withColumn("source", F.col("members")[0])
    return out.join(F.broadcast(shares.withColumnRenamed("source", "__s")), out["source"].eqNullSafe(F.col("__s"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, cuts, and hashes of its output and of the text restored from that."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and hashes of its ids and of the text decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_tokens": op2_tokens,
        "op3_wrapper": op3_wrapper,
        "op4_pseudo_lm": op4_pseudo_lm,
        "op8_fixity": op8_fixity,
        "op5_secrets": op5_secrets,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op9_simhash": op9_simhash,
        "op10_mixing": op10_mixing,
        "op11_fim": op11_fim,
        "op12_bpe": op12_bpe,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": decontaminate.ORACLE, "op11_fim": fim.ORACLE, "op13_phrases": phrases.ORACLE}
