"""Compares a query with its SQL on the same Parquet tables."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name, query, sql):
    df = query(spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection().execute(sql)
    want = rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (name, a, b)
    return len(got[1])
