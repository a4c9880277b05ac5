"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from clausemill.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in at) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    got = _rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    answer = tables.sql(ORACLES[name])
    assert sorted(answer.columns) == sorted(df.columns)
    want = _rows(answer.columns, answer.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9) if any(isinstance(x, float) for x in a) and None not in a else a == b


def test_entry_without_the_corpus_tools(spark, sf):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 6
