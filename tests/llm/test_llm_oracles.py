"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from lorekeep.llm import queries

DIR = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), duck.sql(queries.ORACLES[name]).df()
    for frame in (got, want):
        for c in frame.columns:
            if str(frame[c].dtype).startswith(("Int", "float")):
                frame[c] = frame[c].astype("Int64").astype(object)
    assert len(got) == len(want) and rows(got) == rows(want)
