"""Names whose tokens all occur in another name, against the query's SQL and a brute-force version."""

import random
from collections import Counter

import duckdb
from compare import compare
from pyspark.sql import functions as F

from sparkshelf.operators import joins as J
from sparkshelf.plans import catalogue

NAMES = ["red bolt", "bolt red", "Red  Bolt", "red", "", " ", None, "red bolt ", "red\tbolt", "red red bolt", "ΟΔΟΣ", "οδος", "οδοσ", "İx", "ix", "i̇x", "big red bolt", None, "red bolt"]


def test_query_matches_sql_on_odd_names(spark, tmp_path):
    rows = [*enumerate(NAMES), (None, "red bolt"), (3, "red"), (3, "red"), (None, None)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert compare(catalogue.queries()["j_37"](spark, str(tmp_path)), con, catalogue.oracle_sql()["j_37"]) is None


def test_pairs_of_packed_rows(spark, monkeypatch):
    """Classes of more rows than a list or a group holds, one name far more frequent than others, words that most names have."""
    for limit, n in {"LEFT_PACK": 3, "RIGHT_PACK": 4, "GROUP_ROWS": 16, "TASK_PAIRS": 50}.items():
        monkeypatch.setattr(J, limit, n)
    rng = random.Random(5)
    name = lambda: rng.choice(["product red", " ".join(["product", *rng.sample("abcdef", rng.randint(0, 3))]), rng.choice("abcdef"), None])
    left, right = [(i, name()) for i in range(70)], [(i, name()) for i in range(90)]
    a = spark.createDataFrame(left, "a int, name string").select("a", F.split("name", " ").alias("tokens"))
    got = J.all_tokens_contained(a, "tokens", spark.createDataFrame(right, "b int, name string"), "name", "b")
    assert got.columns == ["a", "tokens", "b_match"]
    assert Counter((r["a"], r["b_match"]) for r in got.collect()) == Counter((i, j) for i, x in left if x for j, y in right if y is None or set(x.split(" ")) <= set(y.split(" ")))
    none = spark.createDataFrame([], "b int, name string")
    assert J.all_tokens_contained(a, "tokens", none, "name", "b").count() == 0


def test_frequent_names_are_dealt_to_many_tasks(spark, tmp_path):
    """Every name is as frequent as in the given tables: two words of eight each. Before, all pairs were made, eight times as many were compared, in one task."""
    n, words = 16_000, [("hot cold red blue old new small large".split())[i] for i in range(8)]
    part = spark.range(0, n, 1, 1).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 8 + 1).cast("int")), F.concat(F.lit("w"), F.floor(F.col("id") / 8) % 8)).alias("p_name"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.queries()["j_37"](spark, str(tmp_path))
    made = out.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == n * n // 64 and max(r["count"] for r in made) <= J.TASK_PAIRS < n * n // 64
