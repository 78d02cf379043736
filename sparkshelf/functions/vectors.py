"""Vector functions over arrays of numbers; all are folds inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null if a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def knn(df: DataFrame, vector: str, query: list[float], k: int, id_col: str) -> DataFrame:
    """The k nearest rows by cosine distance, ties by id; filters on df come first. The query is a literal: no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("distance", cosine_distance(F.col(vector), q)).where("distance is not null").orderBy("distance", id_col).limit(k)


def tiered_knn(df: DataFrame, vector: str, query: list[float], tier: str, cutoff: float, k: int, id_col: str) -> DataFrame:
    """The nearest rows within the cutoff, of the best tier that has any."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = df.withColumn("distance", cosine_distance(F.col(vector), q)).where(F.col("distance") <= cutoff)
    best = near.agg(F.min(tier).alias("__best"))
    return near.join(F.broadcast(best), F.col(tier) == F.col("__best")).drop("__best").orderBy("distance", id_col).limit(k)
