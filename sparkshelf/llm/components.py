"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _stars(edges: DataFrame, low: bool) -> DataFrame:
    """Every node u, with m the least of u and its neighbours: large star ties each greater neighbour to m, small star each
    lesser one and u itself. edges: src > dst."""
    if low:
        near = edges
    else:
        near = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    met = near.join(least, "src")
    if low:
        out = met.select(F.col("dst").alias("a"), "m").union(least.select(F.col("src").alias("a"), "m"))
    else:
        out = met.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("a"), "m")
    return out.where("a <> m").select(F.col("a").alias("src"), F.col("m").alias("dst")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (src, dst): the least node that can be reached. The step count grows with
    the logarithm of the longest path; each round is written to the shared folder, so a lost executor costs no more than
    one round. Edges are any comparable type, in any direction, repeated or not; loops and null ends are dropped; no edges
    give no rows."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now, before = written(now, "cc"), None
    for _ in range(most_rounds):
        after = written(_stars(_stars(now, low=False), low=True), "cc")
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))]
        before = before or now.agg(*mark).first()
        at = after.agg(*mark).first()
        drop_written(now.sparkSession, now)
        now, same, before = after, at == before, at
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())
