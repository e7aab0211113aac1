"""Registered queries against their SQL, on the smallest driver tables if these are there."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: tuple(x) if getattr(x, "ndim", 0) else x
    return [tuple(map(plain, r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)], list(frame.columns)


@pytest.mark.parametrize("name", sorted(n for n in engine.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query_equals_its_sql(spark, duck, name):
    got, want = engine.queries()[name](spark, SF).toPandas(), duck.execute(engine.oracle_sql()[name]).fetchdf()
    key = lambda r: tuple(map(str, r))
    (a, columns), (b, expected) = rows(got), rows(want)
    assert columns == expected and len(a) == len(b)
    assert sorted(map(key, a)) == sorted(map(key, b))


@pytest.mark.parametrize("name", sorted(n for n in engine.queries() if n not in engine.oracle_sql() and not n.startswith(("op", "pipeline"))))
def test_query_runs(spark, name):
    rows = engine.queries()[name](spark, SF).collect()  # all columns, which a count would prune
    assert len(rows) >= (0 if name == "bridges" else 1)


def test_entry(spark):
    assert engine.entry(spark).count() == 20


def test_one_sparse_query_builds_no_index(spark, monkeypatch):
    monkeypatch.setattr("lodestream.plans.tables.sparse_index", None)
    assert len(engine.queries()["bm25_topk"](spark, "/root/testdata/sf0.001").collect()) == 10
