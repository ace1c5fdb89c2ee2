import duckdb
import pytest

from tidewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_says_the_same(spark, sf_dir, name):
    con = duckdb.connect()
    for view in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{view}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    frame = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in frame.select(*columns).collect())
