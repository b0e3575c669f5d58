import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallytree.session import build_session

    conf = {
        "spark.master": "local[8]",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = build_session("tallytree-tests", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted([tuple(r) for r in picked.collect()], key=lambda t: tuple((v is None, str(v)) for v in t))


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(sf_dir):
    """DuckDB with the tables of a folder as views."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def _sorted(records, names, columns):
    picked = [names.index(c) for c in columns]
    out = [tuple(_plain(r[i]) for i in picked) for r in records]
    return sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def assert_equal(got, con, sql):
    """A DataFrame and a SQL text give the same columns and rows, in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    want = _sorted(result.fetchall(), names, columns)
    assert want, "the query must have something to show"
    assert _sorted(got.collect(), got.columns, columns) == want
