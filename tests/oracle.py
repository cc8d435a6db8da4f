"""Side-by-side check of a Spark query and its DuckDB oracle text.

Mirrors the driver's gate: same row count, same column names, and the same
multiset of rows once columns are sorted by name.
"""

from __future__ import annotations

import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], sorted(columns)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_vals, s_cols = rows_of(spark_df.columns, s_rows)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    s_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in spark_df.dtypes}
    d_types = {c[0]: str(c[1]) for c in res.description}
    if s_types != d_types:
        diff = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                if s_types.get(c) != d_types.get(c)}
        return False, f"types differ (spark, duckdb): {diff}"
    d_vals, d_cols_sorted = rows_of(d_cols, res.fetchall())
    if s_cols != d_cols_sorted:
        return False, f"columns differ: spark={s_cols} duckdb={d_cols_sorted}"
    if len(s_vals) != len(d_vals):
        return False, f"row count differs: spark={len(s_vals)} duckdb={len(d_vals)}"
    cs, cd = Counter(s_vals), Counter(d_vals)
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        return False, f"values differ ({s_cols}): spark-only={only_s} duckdb-only={only_d}"
    return True, f"{len(s_vals)} rows"
