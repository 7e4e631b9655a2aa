"""Compares a query with its SQL in DuckDB: rows and values, columns by name, in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x if x is None or isinstance(x, (int, str, bool)) else str(x) if not hasattr(x, "as_tuple") else float(f"{float(x):.9g}")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def differences(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, wanted = rows(rel.columns, rel.fetchall())
    if names != wanted:
        return f"columns {names} and {wanted}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not same(a, b)]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""


def same(a, b) -> bool:
    return all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-12) for x, y in zip(a, b, strict=True))
