import pytest
from compare import agrees

from basketry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert agrees(spark, queries.QUERIES[name], queries.SQL[name]) > 0


def test_mix_comes_near_its_targets(spark):
    rows = queries.op9_mix_sources(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id",
        "source"), "doc_id").toPandas()
    sums = rows.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.source_size).all() and (sums.target <= 2 * sums["size"] + 1e-6).all()
    assert abs(sums.target.sum() - 1.5 * sums["size"].sum()) < 1e-3
    assert ((sums.taken - sums.target).abs() <= 0.03 * sums.target).all()
