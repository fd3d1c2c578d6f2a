"""Audit log, integrity, lineage and the compliance report."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

def canonical(fields: dict[str, Column]) -> Column:
    """One text for a row: names in order, values as text, null apart from empty; the ground of checksums."""
    parts = [F.concat(F.lit(k + "="), F.coalesce(F.concat(F.lit("'"), F.replace(v.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat_ws(", ", *parts)


def checksum(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical(fields), 256)


@F.pandas_udf(T.StringType())
def json_checksum(rows: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys as Python writes it, of JSON text; for logs that were signed that way."""
    return rows.map(lambda t: None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, default=str).encode()).hexdigest())


def log_action(df: DataFrame, fields: list[str]) -> DataFrame:
    """The rows with the checksum of the signed fields."""
    return df.withColumn("checksum", checksum({f: F.col(f) for f in fields}))


def verify(log: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with ``valid``: whether the checksum is that of the fields; a null checksum isn't."""
    return log.withColumn("valid", F.coalesce(F.col("checksum") == checksum({f: F.col(f) for f in fields}), F.lit(False)))


def integrity(log: DataFrame, fields: list[str]) -> DataFrame:
    """One row (total, valid, invalid, verified) over the whole log."""
    v = verify(log, fields)
    return v.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.coalesce(F.bool_and("valid"), F.lit(True)).alias("verified"))


def export_checksum(log: DataFrame, key: str) -> DataFrame:
    """One row (n, export_checksum): a hash of all row checksums and keys, in any order of the rows.

    A tree of hashes: equal rows are counted first, so none is a list of its
    own; leaves are dealt to 16^6 nodes by the digits of their own hash, which
    are even however skewed the log is, and each node hashes at most 4096
    nodes below it, in order.
    """
    rows = log.groupBy(F.col("checksum").alias("c"), F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    level = rows.select("n", F.sha2(F.concat_ws(":", F.coalesce("c", F.lit("")), F.coalesce("k", F.lit("")), F.col("n").cast("string")), 256).alias("h")).select("n", "h", F.col("h").alias("at"))
    for digits in (6, 3, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "\n")
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("h"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.first("h"), F.sha2(F.lit(""), 256)).alias("export_checksum"))


def by_action(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n"))


def by_resource(log: DataFrame) -> DataFrame:
    return log.groupBy("resource_type").agg(F.count("*").alias("n"))


def top_users(log: DataFrame, k: int = 10) -> DataFrame:
    """Users with most events; a tie goes to the lower user, null users are left out."""
    return log.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(k)


def hourly(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("timestamp", "yyyy-MM-dd HH:00").alias("hour")).agg(F.count("*").alias("n"))


def summary(log: DataFrame) -> DataFrame:
    """total_events, unique_users and unique_resources (distinct resource types)."""
    return log.agg(F.count("*").alias("total_events"), F.count_distinct("user_id").alias("unique_users"), F.count_distinct("resource_type").alias("unique_resources"))


def report(log: DataFrame, fields: list[str], start=None, end=None) -> DataFrame:
    """(section, key, n): the whole report in one pass over the log.

    Grouping sets give actions, resources, users, hours and integrity at once;
    only the ten most active users are kept of theirs.  A range of time narrows
    the counts, never integrity, which is that of the whole log.
    """
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("timestamp") >= F.lit(start))
    if end is not None:
        inside = inside & (F.col("timestamp") <= F.lit(end))
    valid = F.when(F.col("valid"), "valid").otherwise("invalid").alias("valid")
    base = verify(log, fields).select(F.col("action"), F.col("resource_type").alias("resource"), F.col("user_id").cast("string").alias("usr"), F.date_format("timestamp", "yyyy-MM-dd HH:00").alias("hour"), valid, F.coalesce(inside, F.lit(False)).alias("inside"))
    g = base.groupingSets([["action"], ["resource"], ["usr"], ["hour"], ["valid"], []], "action", "resource", "usr", "hour", "valid").agg(F.count_if("inside").alias("n"), F.count("*").alias("whole"), F.grouping_id().alias("g"))
    names = {15: ("action", "action"), 23: ("resource", "resource"), 27: ("user", "usr"), 29: ("hour", "hour"), 30: ("integrity", "valid"), 31: ("total", None)}
    sec, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for gid, (s, c) in names.items():
        sec = F.when(F.col("g") == gid, s).otherwise(sec)
        key = F.when(F.col("g") == gid, F.col(c) if c else F.lit("events")).otherwise(key)
    flat = g.select(sec.alias("section"), key.alias("key"), F.when(F.col("g") == 30, F.col("whole")).otherwise(F.col("n")).alias("n")).where("n > 0 or section = 'total'")
    users = flat.where("section = 'user' and key is not null").orderBy(F.desc("n"), F.col("key").cast("bigint"), "key").limit(10)
    # Both states of integrity are there, zero included.
    both = log.sparkSession.createDataFrame([("integrity", "valid"), ("integrity", "invalid")], "section string, key string")
    i = both.join(F.broadcast(flat.where("section = 'integrity'")), ["section", "key"], "left").select("section", "key", F.coalesce("n", F.lit(0)).alias("n"))
    return flat.where("section not in ('user', 'integrity')").unionByName(users).unionByName(i)


def track(record_id: Column, source_type: Column, parent: Column) -> list[Column]:
    """Columns of a lineage row; its id follows from its content."""
    return [F.sha2(F.concat_ws("|", record_id, source_type, parent), 256).alias("id"), record_id.alias("record_id"), source_type.alias("source_type"), parent.alias("parent_record_id")]


def ancestors(lineage: DataFrame) -> DataFrame:
    """(record_id, ancestor_id, depth) of every record, however deep; a cycle ends where it closes, no record is its own ancestor.

    Paths double from step to step: those of exactly d edges are joined with
    all of up to d, so a chain of n levels takes log n joins; of several ways
    to an ancestor the shortest counts.
    """
    edge = lineage.select(F.col("record_id").cast("string").alias("record_id"), F.col("parent_record_id").cast("string").alias("ancestor_id"), F.lit(1).alias("depth"))
    known = materialize(edge.where("record_id is not null and ancestor_id is not null and record_id <> ancestor_id").distinct(), "ancestors")
    reach = 1
    while True:
        ends = known.where(F.col("depth") == reach).select("record_id", F.col("ancestor_id").alias("mid"))
        more = ends.join(known.select(F.col("record_id").alias("mid"), "ancestor_id", "depth"), "mid").where("record_id <> ancestor_id")
        more = more.select("record_id", "ancestor_id", (F.col("depth") + reach).alias("depth"))
        grown = materialize(known.unionByName(more).groupBy("record_id", "ancestor_id").agg(F.min("depth").alias("depth")), "ancestors")
        reach *= 2
        known = grown
        if known.where(F.col("depth") == reach).isEmpty():
            return known
