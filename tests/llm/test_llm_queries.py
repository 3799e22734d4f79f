"""Registered llm queries: SQL where there is some, and the shape that the rest must have."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import oracle  # noqa: E402

from tessera.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert not oracle.differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op3_decontamination"}))
def test_every_document_once(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    ids = [r.doc_id for r in rows.select("doc_id").distinct().collect()]
    assert len(ids) == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
