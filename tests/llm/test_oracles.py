"""Queries with an SQL twin against it, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lamina.llm.registry import ORACLES, QUERIES
from tests.test_oracles import rows


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(key, spark, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    found = con.execute(ORACLES[key])
    names, want = [d[0] for d in found.description], found.fetchall()
    df = QUERIES[key](spark, folder)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {n: kinds[k] for n, k in df.dtypes} == {d[0]: str(d[1]) for d in found.description}
    assert rows(df.columns, df.collect()) == rows(names, want)


def test_registry_is_complete():
    assert [k for k in QUERIES if k.startswith("op")] == sorted((k for k in QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 11)) and "pipeline" in __spark_entry__.queries()
