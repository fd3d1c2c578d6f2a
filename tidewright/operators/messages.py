"""Messages delivered more than once: one copy per identifier (problem 6).

Storage is log-structured.  An *upsert* turns a batch of deliveries into
sorted runs: every input split is sorted by (bucket, identifier, order) and
written with equal identifiers already collapsed onto the first of them, so a
run holds at most one survivor per identifier however hot it is.  A
*compaction* routes the survivors by bucket and sorts them by (bucket,
identifier, order), which merges the runs of a bucket, and collapses equal
identifiers across runs as they stream by, one row in memory at a time.  Loading the same batch again
overwrites the same runs, and a copy of a delivery collapses onto itself.

Skew: an identifier that holds a third of all rows is cut down to one
survivor per input split before anything is shuffled by identifier; its copies
are joined on the survivor of their own split, so no group is larger than a
split.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: A power of two; the high bits of the identifier hash choose the bucket.
BUCKETS = 1024


def uuid_key(col: Column) -> Column:
    """The 32 hex digits of a UUID however spelled; other text as trimmed; null if blank.

    Letter case, hyphens, braces, quotes, white space and the prefixes
    ``urn:uuid:`` and ``uuid:`` are spelling.
    """
    plain = F.regexp_replace(F.lower(col), r"^[^0-9a-z]*(?:urn[^0-9a-z]*)?(?:uuid[^0-9a-z]*)?", "")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")
    text = F.regexp_replace(col, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")
    return F.when(plain.rlike(r"^[0-9a-f]{32}$"), plain).when(text != "", F.concat(F.lit("="), text))


def _collapse(batches):
    """Neighbours of equal identifier in sorted rows get the first one's number; the same delivery again is dropped."""
    last_key = last_first = last_order = None
    for b in batches:
        if not b.num_rows:
            continue
        key, order = b.column("k"), b.column("o").to_numpy(zero_copy_only=False)
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(order) - 1)).to_numpy(zero_copy_only=False)
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (order[1:] == order[:-1])
        starts = np.flatnonzero(new)
        first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
        if key[0].as_py() == last_key:
            first[: starts[1] if len(starts) > 1 else len(order)] = last_first
            again[0] = order[0] == last_order
        last_key, last_first, last_order = key[len(order) - 1].as_py(), int(first[-1]), int(order[-1])
        yield pa.RecordBatch.from_arrays([b.column("b"), key, b.column("o"), pa.array(first)], names=["b", "k", "o", "f"]).filter(pa.array(~again))


RUN = "b int, k string, o bigint, f bigint"


class MessageStore:
    """Hash-bucketed sorted runs of one delivery stream below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path or scratch(spark, "messages"), buckets
        self.batches: list[str] = []

    def upsert(self, df: DataFrame, batch: str, id_col: str = "event_id", order_col: str = "delivery_id") -> "MessageStore":
        """Write the sorted runs of one batch.  Rows without an identifier are not stored: they have no copies."""
        rows = df.select(uuid_key(F.col(id_col)).alias("k"), F.col(order_col).cast("bigint").alias("o"))
        rows = rows.where(F.col("k").isNotNull() & F.col("o").isNotNull())
        rows = rows.select(F.pmod(F.xxhash64("k"), F.lit(self.buckets)).cast("int").alias("b"), "k", "o")
        runs = rows.sortWithinPartitions("b", "k", "o").mapInArrow(_collapse, RUN)
        runs.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{batch}")
        if batch not in self.batches:
            self.batches.append(batch)
        return self

    def _runs(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{b}" for b in self.batches])

    def compact(self) -> DataFrame:
        """(f, kept) of every run's survivors, kept being the lowest over all runs; written as one sorted run per task."""
        heads = self._runs().where("o = f").select("b", "k", "o").repartition("b").sortWithinPartitions("b", "k", "o")
        path = f"{self.path}/compacted-{uuid.uuid4().hex}"
        heads.mapInArrow(_collapse, RUN).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(RUN).parquet(path).select(F.col("o").alias("f"), F.col("f").alias("kept"))

    def copies(self) -> DataFrame:
        """(kept_id, copy_id) of every delivery that is not the first of its identifier."""
        heads = self.compact().where("f <> kept")
        inside = self._runs().where("o <> f").select("f", "o")
        if len(self.batches) > 1:  # the same delivery may lie in several batches, under several survivors
            inside = inside.groupBy("o").agg(F.min("f").alias("f"))
        inside = inside.join(heads, "f", "left").select(F.coalesce("kept", "f").alias("kept_id"), F.col("o").alias("copy_id"))
        out = heads.select(F.col("kept").alias("kept_id"), F.col("f").alias("copy_id")).unionByName(inside).where("kept_id <> copy_id")
        return out.distinct() if len(self.batches) > 1 else out


def message_copies(df: DataFrame, id_col: str = "event_id", order_col: str = "delivery_id") -> DataFrame:
    """(kept_id, copy_id) over one table of deliveries.

    Null and blank identifiers have no copies; a null order number is no
    delivery; repeated rows with the same number are one delivery.  An empty
    table gives no rows.
    """
    store = MessageStore(df.sparkSession)
    return store.upsert(df, "batch").copies()


def deduplicate(df: DataFrame, id_col: str = "event_id", order_col: str = "delivery_id") -> DataFrame:
    """``df`` without the later deliveries of each identifier; rows without identifier all stay."""
    gone = message_copies(df, id_col, order_col).select(F.col("copy_id").alias(order_col))
    return df.join(gone, order_col, "left_anti").select(*df.columns)
