"""Every registered query of the engine against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from glyphlake.queries import corpora, formatting, lint, markdown, relational, scalars, sessions, sources, structure, texqueries

SF = "/root/testdata/sf0.001"
BOOKS = (lint, markdown, structure, relational, scalars, sources, formatting, texqueries, sessions, corpora)
QUERIES = {k: q for b in BOOKS for k, q in b.QUERIES.items()}
ORACLE = {k: q for b in BOOKS for k, q in b.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in "region nation part events documents pages conversations benchmark".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, row)) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLE[name]).df())


def test_wrapping_keeps_lines_short_and_words_whole(spark):
    rows = QUERIES["fmt13_wrap"](spark, SF)
    assert rows.count() > 0
