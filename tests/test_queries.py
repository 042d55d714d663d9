"""Every query against its SQL in an independent engine, over the smallest test tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from parsewarden.plans.oracles import ORACLES
from parsewarden.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(round(float(x), 9)) if isinstance(x, float | int) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return c


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, engine, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    own = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert own == theirs


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@needs_tables
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "page_count_match", "pass_pages", "review_pages", "failed_pages", "status"]
