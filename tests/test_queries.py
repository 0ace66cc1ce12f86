"""Every query of the library against its SQL, and what the driver asks of the entry."""

import math

import duckdb
import pytest

import __spark_entry__
from quireflow.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table):
    plain = lambda v: ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*([plain(v) for v in table.column(n).to_pylist()] for n in names), strict=True)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    got = rows(catalog.queries()[name](spark, DATA).toArrow())
    assert got == rows(duck.sql(catalog.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.schema == __spark_entry__.entry(spark).schema
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["doc_chunks", "chunk_scorecard", "heading_paths", "reading_order", "bundle_diff"])
def test_any_number_of_partitions(spark, name):
    first = rows(catalog.queries()[name](spark, DATA).toArrow())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(catalog.queries()[name](spark, DATA).toArrow()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
