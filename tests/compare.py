"""Run a query and its SQL counterpart and compare rows, regardless of their order."""

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir):
    """(row count, list of complaints)"""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = rows_of(names, answer.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} / {len(want)}")
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        out.append(f"{len(bad)} rows differ, first {bad[:1]}")
    return len(got), out
