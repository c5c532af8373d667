"""Every catalogue query against its SQL in DuckDB on the same tables, and none of them vacuous."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog, ingest
from tessera.session import TABLES

SF = "/root/testdata/sf0.01"
#: Queries whose point is that nothing comes back.
NONE = {"filter_candidates_empty", "filter_division_repeated"}
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cells(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.toPandas()
    assert bool(len(got)) == (name not in NONE)
    if (sql := catalog.ORACLE_SQL.get(name)) is not None:
        want = duck.sql(sql)
        assert {c: KINDS.get(k, k) for c, k in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
        assert cells(got) == cells(want.df())


@pytest.mark.parametrize("name", sorted(ingest.EXAMPLES))
def test_example(spark, duck, name):
    make, sql = ingest.EXAMPLES[name]
    assert name not in catalog.QUERIES
    df, want = make(spark, SF), duck.sql(sql)
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert cells(df.toPandas()) == cells(want.df())


def test_all_have_sql_or_are_known():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {
        "search_by_vector_index", "cluster_online", "cluster_video", "fts_cover_density", "page_metadata", "stream_links", "stream_people",
    }
