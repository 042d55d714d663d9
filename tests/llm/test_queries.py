"""Queries against their SQL in an independent engine."""

from __future__ import annotations

import os

import duckdb
import pytest

from parsewarden.llm.queries import ORACLES, QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.001"


def compare(spark, name, d):
    engine = duckdb.connect()
    for f in os.listdir(d):
        where = f"{d}/{f}" if os.path.isfile(f"{d}/{f}") else f"{d}/{f}/*.parquet"
        engine.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{where}'")
    df = QUERIES[name](spark, d)
    columns = sorted(df.columns)
    result = engine.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    text = lambda rows, at: sorted(tuple("" if r[i] is None else str(r[i]) for i in at) for r in rows)
    assert text(df.select(*columns).collect(), range(len(columns))) == text(result.fetchall(), [names.index(c) for c in columns])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, SF_DIR)


@pytest.mark.parametrize("name", ["op6_ngram_join", "op8_suffix_dedup"])
def test_query_equals_sql_on_odd_texts(spark, tmp_path, name):
    docs = cases.documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    compare(spark, name, cases.write(spark, tmp_path, documents=docs))
