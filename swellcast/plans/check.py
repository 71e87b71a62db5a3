"""Local Spark-vs-DuckDB comparison, mirroring the driver's correctness gate:
same column names, same row count, same multiset of rounded values."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from .queries import ORACLES, QUERIES
    sdf = QUERIES[name](spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    con = con or duck(sf_dir)
    rel = con.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    res = {"name": name, "spark_rows": len(srows), "duck_rows": len(drows),
           "cols_match": sorted(scols) == sorted(dcols)}
    if res["cols_match"]:
        order = sorted(range(len(scols)), key=lambda i: scols[i])
        dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=repr)
        b = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=repr)
        res["values_match"] = a == b
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            res["first_diffs"] = diff
    else:
        res["spark_cols"], res["duck_cols"] = scols, dcols
    return res
