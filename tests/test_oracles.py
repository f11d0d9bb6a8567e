"""Every registered query against its SQL twin on the small tables."""

import math
import os

import duckdb
import pytest

from lamina.plans.registry import ORACLES, QUERIES


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.7f}"
        return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, folder, duck):
    df = QUERIES[key](spark, folder)
    got = df.collect()
    assert key in ORACLES
    found = duck.execute(ORACLES[key])
    names, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(names) == sorted(df.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {n: kinds.get(k, k) for n, k in df.dtypes} == {d[0]: str(d[1]) for d in found.description}
    assert rows(df.columns, got) == rows(names, want)


@pytest.mark.parametrize("key", ["tokenize_count", "tokenize_lengths"])
def test_odd_texts(key, spark, tmp_path):
    texts = [None, "", " ", "\n", " \n\t\r\n", "a", "\na b\n", "a\r\n b\x0b", "é 👍🏽‍"]
    con, at = duckdb.connect(), f"{tmp_path}/documents.parquet"
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    con.execute(f"copy documents to '{at}' (format parquet)")
    df, found = QUERIES[key](spark, str(tmp_path)), con.execute(ORACLES[key])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in found.description], found.fetchall())
