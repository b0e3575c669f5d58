"""One filing with a third of all orders, joins that never broadcast, skew splits at any size."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

from conftest import TABLES, assert_equal, open_tables

SOURCE = "/root/testdata/sf0.001"
EAGER_SPLITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        if name != "orders":
            os.symlink(f"{SOURCE}/{name}.parquet", folder / f"{name}.parquet")
    duckdb.sql(f"""COPY (SELECT * REPLACE (CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS BIGINT) AS o_custkey)
                   FROM '{SOURCE}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.fixture(scope="module")
def eager(spark):
    before = {key: spark.conf.get(key, None) for key in EAGER_SPLITS}
    for key, value in EAGER_SPLITS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("name", [
    "balance_sheet", "income_statement", "disclosure_table", "tree_order", "label_tiers", "filing_first_period"])
def test_hot_filing_gives_the_same_rows(eager, skewed, name):
    con = open_tables(skewed)
    assert_equal(contract.queries()[name](eager, skewed), con, contract.oracle_sql()[name])
    con.close()
