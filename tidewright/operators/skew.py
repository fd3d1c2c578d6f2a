"""Keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on; so there are at most ``HOT`` hot keys, whatever the data.
HOT = 1000
#: Below this number of rows no key needs special treatment.
LEAST = 50_000


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key): those with at least ``total / HOT`` rows, so at most ``HOT``; None where there are too few rows for any to matter.

    Only keys cross the shuffle, combined in the tasks first.
    """
    if total < LEAST:
        return None
    least = max(LEAST, -(-total // HOT))
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
