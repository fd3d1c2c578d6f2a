"""Joins on ranges: points in intervals, and intervals that overlap, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / width)


def _spread(df: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    ok = df.where(F.col(lo) <= F.col(hi))
    return ok.withColumn("_b", F.explode(F.sequence(_bucket(F.col(lo), width), _bucket(F.col(hi), width))))


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points with every range that holds them, both ends included; all columns of both.

    Ranges are dealt to the buckets of ``width`` they touch and points to their
    own, so the join is one on equal buckets and a pair meets once.  ``width``
    near the usual length of a range is best; any gives the same rows.  A null
    point or end, and a range that ends before it begins, has no partner.
    """
    p = points.where(F.col(x).isNotNull()).withColumn("_b", _bucket(F.col(x), width))
    return p.join(_spread(ranges, lo, hi, width), "_b").where((F.col(x) >= F.col(lo)) & (F.col(x) <= F.col(hi))).drop("_b")


def interval_join(left: DataFrame, right: DataFrame, width: float, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of intervals ``a`` of the left and ``b`` of the right that overlap or touch, each once: in the first bucket they share."""
    j = _spread(left, *a, width).join(_spread(right, *b, width), "_b")
    j = j.where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    return j.where(F.col("_b") == F.greatest(_bucket(F.col(a[0]), width), _bucket(F.col(b[0]), width))).drop("_b")
