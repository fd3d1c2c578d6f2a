"""Run queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings basecamp_schemas ingestion_jobs data_records entity_requests entity_payloads entity_changes event_messages pack_sizes".split()


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(map(_plain, v))
    return v if isinstance(v, (int, str, bool)) else str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def rows_of_duckdb(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())


def difference(df, sql: str, sf_dir: str) -> str:
    """'' if both give the same rows under the same names, else what differs."""
    c1, a = rows_of_spark(df)
    c2, b = rows_of_duckdb(sql, sf_dir)
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if a == b:
        return "" if a else "both empty"
    return f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
