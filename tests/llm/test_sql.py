"""Queries that SQL can express, against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from lorekeep.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(repr([r[c] for c in columns]) for r in frame.collect())
    found = db.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
