import corpus_pipeline
import pytest
from compare import compare, connect

import __spark_entry__ as entry


def test_stages_compose_like_brute_force(spark, sf):
    """run() equals the stages one by one on collected rows; every stage but the last keeps the columns of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).toPandas(), docs.schema)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert 0 < counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    last = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()))
    assert last == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert len(last) == counts[4]


def test_names():
    keys = entry.queries()
    for n in range(1, 11):
        assert [k for k in keys if k.startswith(f"op{n}_")], n
    assert "pipeline" in keys and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("key", [k for k in entry.oracle_sql() if k.startswith("op") and k[2].isdigit()])
def test_sql_twins(spark, sf, key):
    assert compare(entry.queries()[key](spark, sf), connect(sf), entry.oracle_sql()[key]) is None
