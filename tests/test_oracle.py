import pytest
from compare import agrees

from basketry.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert agrees(spark, QUERIES[name], SQL[name]) > 0


def test_match_table_keeps_every_line(spark):
    """Every line of one part is skipped, matched with dense ranks, or a row without a match."""
    rows = QUERIES["match_table"](spark, "/root/testdata/sf0.001").toPandas().drop_duplicates()
    ranks = rows.dropna(subset=["match_rank"]).groupby("line_id")["match_rank"].apply(lambda r: sorted(r) == list(range(1, len(r) + 1)))
    assert ranks.all() and len(ranks) > 1000
    counts = rows.groupby("line_id")["match_rank"].agg(["size", "count"])
    assert ((counts["count"] > 0) | (counts["size"] == 1)).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_rule_fires_and_does_not(spark):
    """Each grocery rule holds for some of the registered pairs and not for others."""
    rows = QUERIES["grocery_rules"](spark, "/root/testdata/sf0.01").select("fired").toPandas()["fired"].str.split(",")
    fired = {n: sum(n in r for r in rows) for n in set().union(*rows) - {""}}
    assert all(0 < k < len(rows) for k in fired.values())
    from basketry.operators import rules as rl

    assert set(fired) == {r.name for r in rl.default_rules()}
