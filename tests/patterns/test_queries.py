"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF
from trailmark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table):
    table = table.select(sorted(table.column_names))
    return [(f.name, str(f.type)) for f in table.schema], sorted(str(tuple(r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toArrow()) == rows(db.sql(queries.SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
