"""Every named query against its SQL, and independence of the partitioning."""

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()
QUERIES = queries()
# Fits a model; exercised by test_model.py on fewer trees.
SLOW = {"train_score", "feature_importance", "model_comparison", "hyperparameter_search"}


@pytest.fixture(scope="session")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, sf, name):
    if name in SQL:
        assert oracle.difference(spark, con, sf, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["detect_sources", "limiter_decisions", "trailing_hits", "roc_auc",
                                  "cic_exclusions", "model_rollup"])
@pytest.mark.parametrize("partitions", [1, 16])
def test_partitioning_does_not_matter(spark, con, sf, name, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert oracle.difference(spark, con, sf, QUERIES[name], SQL[name]) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
