"""The SQL twins against the queries on the smallest tables, and the hash functions written in SQL."""

import random
import zlib

import duckdb
import pytest
import xxhash

from glyphlake.llm import hashsql
from glyphlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def sorted_rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("null" if x is None or x != x else str(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    assert sorted_rows(QUERIES[name](spark, SF).toPandas()) == sorted_rows(con.execute(ORACLE_SQL[name]).df().replace({float("nan"): None}))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    con = duckdb.connect()
    made = ["".join(rnd.choice("ab é漢😀\n0") for _ in range(n)) for n in [*range(0, 80), 500, 3000]]
    con.execute("CREATE TABLE t (text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[x] for x in made])
    return con


def test_crc32_in_sql(texts):
    rows = texts.execute(f"WITH codes AS ({hashsql.CRC_CODES}) SELECT text, {hashsql.crc32('text')} FROM t, codes").fetchall()
    assert len(rows) == 82 and all(c == zlib.crc32(t.encode()) for t, c in rows)


@pytest.mark.parametrize("seed", [0, 42])
def test_xxh64_in_sql(texts, seed):
    rows = texts.execute(f"WITH {hashsql.xxh64_steps('t', 'text', seed)} SELECT text, h FROM xx").fetchall()
    assert len(rows) == 82 and all(h == xxhash.xxh64_intdigest(t.encode(), seed) for t, h in rows)
