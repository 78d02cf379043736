"""Catalog lookups by name, review ingest and re-scrape plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkshelf.functions.similarity import plain_ratio, token_set
from sparkshelf.operators.resolution import searched


def name_lookup(rows: DataFrame, name: str, query: str, group: str, id_col: str, least: float = 60.0, margin: float = 10.0) -> DataFrame:
    """Rows whose name is close to the query: at least ``least`` and within ``margin`` of the best, with ``answer``: one group, several, or none."""
    scored = rows.withColumn("score", token_set(F.lower(name), F.lit(query.lower()))).where(F.col("score") >= least)
    top = scored.agg(F.max("score").alias("__top"))
    near = scored.join(F.broadcast(top), F.col("score") >= F.col("__top") - margin).drop("__top")
    groups = near.agg(F.count_distinct(F.coalesce(F.col(group).cast("string"), F.col(id_col).cast("string"))).alias("__g"))
    return near.join(F.broadcast(groups)).withColumn("answer", F.when(F.col("__g") == 1, "single").otherwise("several")).drop("__g").orderBy(F.desc("score"), id_col)


def nearest_compound(left: DataFrame, a: str, right: DataFrame, b: str, id_col: str) -> DataFrame:
    """For each a the id of the right row with the greatest (token-set ratio, ratio, id); a without any that scores above 0 gives no row."""
    found = searched(left, a, right, b, "token_set")
    top = found.groupBy("text").agg(F.max("score").alias("s")).join(found, "text").where("score = s")
    met = top.join(right.select(F.col(b).alias("ref"), id_col), "ref")
    key = F.struct(F.col("s"), plain_ratio(F.col("text"), F.col("ref")).alias("r"), F.col(id_col).alias("id"))
    return met.groupBy(F.col("text").alias(a)).agg(F.max(key).alias("k")).select(a, F.col("k.id").alias(id_col), F.col("k.s").alias("score"))


def admissible(options: DataFrame, choices: DataFrame) -> DataFrame:
    """choices (chip, option_group, value) that their chip allows."""
    return choices.join(options.where(~F.col("is_blocked")).select("chip", "option_group", "value"), ["chip", "option_group", "value"], "left_semi")


def ingest(found: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """New rows of found, once each, with status and reason by whether they have a text."""
    new = found.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return new.withColumn("status", F.when(F.coalesce(F.trim(text), F.lit("")) == "", "rejected").otherwise("pending")).withColumn("reason", F.when(F.col("status") == "rejected", "no transcript"))


def retried(work: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """work after another attempt: attempts + 1 for those that were fetched; those that came with a text are pending again."""
    f = fetched.select(key, F.col("text").alias("__t"), F.lit(True).alias("__f"))
    j = work.join(f, key, "left")
    got = F.coalesce(F.trim("__t"), F.lit("")) != ""
    return j.withColumn("attempts", F.col("attempts") + F.when(F.col("__f"), 1).otherwise(0)).withColumn("status", F.when(got, "pending").otherwise(F.col("status"))).drop("__t", "__f")


def outcome_counts(df: DataFrame, outcome: str) -> DataFrame:
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def scrape_plan(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """What a scrape would do with each fetched row (sku, spec, slug, digest): unchanged, sku, attach, slug or insert. Read only."""
    by = lambda c: stored.where(F.col(c) != "").groupBy(F.col(c).alias(f"__{c}")).agg(F.min("id").alias(f"__id_{c}"), F.max("digest").alias(f"__d_{c}"))
    j = fetched
    for c in ("sku", "spec", "slug"):
        j = j.join(by(c), F.col(c) == F.col(f"__{c}"), "left")
    plan = F.when(F.col("__d_sku") == F.col("digest"), "unchanged").when(F.coalesce("sku", F.lit("")) == "", "no_sku").when(F.col("__id_sku").isNotNull(), "sku").when(F.col("__id_spec").isNotNull(), "attach").when(F.col("__id_slug").isNotNull(), "slug").otherwise("insert")
    return j.select(*fetched.columns, plan.alias("plan"), F.coalesce("__id_sku", "__id_spec", "__id_slug").alias("stored_id"))


def decide(preview: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions to write: the chosen rows, if all of them can be chosen now (outcome matched, decision differs); else none."""
    can = preview.where("outcome = 'matched' and decision = 'differs'").select(*keys).distinct()
    bad = chosen.join(can, keys, "left_anti").agg(F.count(F.lit(1)).alias("__bad"))
    return chosen.join(F.broadcast(bad)).where("__bad = 0").drop("__bad")


def tie_profile(matches: DataFrame) -> DataFrame:
    """(bucket, n, mean_gap) of fuzzy matches (score, gap, tied) by how many keys share the best score."""
    bucket = F.when(F.col("tied") <= 1, "single").when(F.col("tied") <= 3, "few").otherwise("many")
    return matches.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"))


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
