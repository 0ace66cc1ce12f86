import duckdb
import pytest

from quireflow.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    r = c.execute(queries.oracle_sql()[name])
    columns, want = [x[0] for x in r.description], r.fetchall()
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(x)) for x in df.select(*columns).collect()) == sorted(map(repr, want))


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
