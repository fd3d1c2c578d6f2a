"""Apply a stream of creates, updates and deletes (problem 2).

Bucketed copy-on-write.  The state lies in files by hash bucket of the entity;
a manifest names the files of the current version.  A load collapses its own
events first, finds the buckets they touch, merges only those with the stored
rows of the same buckets, writes replacement files and commits a new manifest;
files of untouched buckets are carried over by name.

Two kinds of files lie in a bucket: the ledger of the events seen, each once at
its lowest ``feed_seq``, and the entities they leave.  Loads may therefore come
late, out of order or twice, equal timestamps included (``p2_merged`` does so).  An entity is there if
the last of its creates and deletes is a create; its fields are that create's,
overlaid by the latest update of each field after it.  No group is folded event
by event: every step is an aggregate with map-side combine, so an entity with
a third of all events costs one row per field and task.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontext as J
from ..session import scratch

LEDGER = "event string, entity_id string, kind string, ts timestamp_ntz, seq bigint, data string"
STATE = "entity_id string, field_name string, field_value string"
FIELDS = T.ArrayType(T.StructType([T.StructField("f", T.StringType()), T.StructField("v", T.StringType())]))


@F.pandas_udf(FIELDS)
def created_fields(data: pd.Series) -> pd.Series:
    """The fields of a created entity that aren't null, values as written."""

    def one(text):
        d = J.read(text)
        return [(k, J.scalar(v)) for k, v in d.items() if v is not None] if isinstance(d, dict) else []

    return data.map(one)


@F.pandas_udf(FIELDS)
def updated_fields(data: pd.Series) -> pd.Series:
    """The fields an update sets: a value, or ``new`` of an object with ``old`` and ``new``; None clears."""

    def one(text):
        d = J.read(text)
        if not isinstance(d, dict):
            return []
        return [(k, J.scalar(v["new"] if isinstance(v, dict) and "new" in v and "old" in v else v)) for k, v in d.items()]

    return data.map(one)


def normalize_feed(df: DataFrame) -> DataFrame:
    """Each event once, at its lowest ``feed_seq``: (event, entity_id, kind, ts, seq, data).

    Events without entity, time or a known type have no effect.  A null or
    blank ``event_id`` makes an event of its own.
    """
    eid = F.lower(F.trim("event_id"))
    kind = F.element_at(F.split(F.lower(F.trim("event_type")), r"\."), -1)
    rows = df.select(
        F.when(F.coalesce(eid, F.lit("")) != "", eid).otherwise(F.concat(F.lit("#"), F.col("feed_seq").cast("string"))).alias("event"),
        F.col("feed_seq").alias("seq"),
        "entity_id",
        F.substring(kind, 1, 1).alias("kind"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.when(kind == "created", F.col("entity_data")).when(kind == "updated", F.col("changes")).alias("data"),
        kind.isin("created", "updated", "deleted").alias("ok"),
    ).where("ok and entity_id is not null and ts is not null and seq is not null")
    return _once(rows.drop("ok"))


def _once(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.min_by(F.struct("entity_id", "kind", "ts", "seq", "data"), "seq").alias("e")).select("event", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """(entity_id, field_name, field_value) that deduplicated events leave behind."""
    order = F.struct("ts", "seq")
    base = events.where("kind in ('c', 'd')").groupBy("entity_id").agg(F.max_by(F.struct("kind", "data", order.alias("b")), order).alias("w"))
    base = base.select("entity_id", "w.*").where("kind = 'c'")
    made = base.select("entity_id", F.explode(created_fields("data")).alias("x")).select("entity_id", F.col("x.f").alias("f"), F.col("x.v").alias("v"), F.lit(0).alias("late"))
    ups = events.where("kind = 'u' and data is not null").select("entity_id", order.alias("o"), F.explode(updated_fields("data")).alias("x"))
    ups = ups.groupBy("entity_id", F.col("x.f").alias("f")).agg(F.max_by(F.struct("x.v", "o"), "o").alias("w"))
    ups = ups.join(base.select("entity_id", "b"), "entity_id").where("w.o > b").select("entity_id", "f", F.col("w.v").alias("v"), F.lit(1).alias("late"))
    both = made.unionByName(ups).groupBy("entity_id", "f").agg(F.max_by(F.struct("v"), "late").alias("w"))
    return both.select("entity_id", F.col("f").alias("field_name"), F.col("w.v").alias("field_value")).where("field_value is not null")


class _Files:
    """The few file operations a manifest needs, on whatever file system Spark uses."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._none = lambda how: spark.sparkContext._gateway.new_array(how, 0)
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(self._conf)
        self._io = jvm.org.apache.commons.io.IOUtils

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        s = self._fs.open(self._path(path))
        try:
            return self._io.toString(s, "UTF-8")
        finally:
            s.close()

    def commit(self, path: str, text: str) -> None:
        """Write under another name, then rename: readers see the whole manifest or none."""
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        s = self._fs.create(self._path(tmp), True)
        try:
            s.write(bytearray(text.encode()))
        finally:
            s.close()
        jvm, target = self._jvm, self._path(path)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        how = jvm.org.apache.hadoop.fs.Options.Rename
        try:  # a rename that never replaces what another writer committed
            context.rename(self._path(tmp), target, self._none(how))
        except Exception as e:
            self._fs.delete(self._path(tmp), False)
            raise RuntimeError(f"another writer committed {path}") from e

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class CowTable:
    """An entity table kept as bucket files and manifests below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 256):
        """``buckets`` stays for the life of a table; a bucket that grows is kept in more files."""
        self.spark, self.path, self.buckets = spark, path or scratch(spark, "cow"), buckets
        self.files = _Files(spark, self.path)
        self._listed: dict[str, set[str]] = {}

    def version(self) -> int:
        return max((int(n[9:-5]) for n in self.files.names(self.path) if n.startswith("manifest-") and n.endswith(".json")), default=0)

    def manifest(self) -> dict[str, str]:
        """Bucket -> version directory that holds its current files."""
        v = self.version()
        return json.loads(self.files.read(f"{self.path}/manifest-{v}.json"))["buckets"] if v else {}

    def _bucket(self):
        return F.pmod(F.xxhash64("entity_id"), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, schema: str, where: dict[str, str]) -> DataFrame:
        paths = [f"{d}/{kind}/bucket={b}" for b, d in where.items() if f"bucket={b}" in self._names(f"{d}/{kind}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _names(self, path: str) -> set[str]:
        if path not in self._listed:
            self._listed[path] = set(self.files.names(path))
        return self._listed[path]

    def _write(self, df: DataFrame, path: str, *order: str) -> None:
        # Balanced by size at run time: small buckets share a task, one with a hot entity is split over as many as it needs.
        rows = df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        rows.sortWithinPartitions("bucket", *order).write.option("compression", "zstd").partitionBy("bucket").parquet(path)

    def apply(self, feed: DataFrame) -> "CowTable":
        """Merge one load of the change feed and commit; a failure leaves the old version."""
        version, old = self.version() + 1, self.manifest()
        target = f"{self.path}/data-{version}-{uuid.uuid4().hex[:8]}"
        events = normalize_feed(feed)
        if old:
            # Touched buckets: at most ``self.buckets`` small numbers reach the driver.
            touched = {str(r[0]) for r in feed.where("entity_id is not null").select(self._bucket()).distinct().collect()}
            stored = self._read("ledger", LEDGER, {b: d for b, d in old.items() if b in touched})
            events = _once(stored.unionByName(events))
        self._write(events, f"{target}/ledger", "entity_id", "event")
        new = dict.fromkeys((n[7:] for n in self.files.names(f"{target}/ledger") if n.startswith("bucket=")), target)
        self._write(fold(self._read("ledger", LEDGER, new)), f"{target}/state", "entity_id", "field_name")
        self.files.commit(f"{self.path}/manifest-{version}.json", json.dumps({"version": version, "buckets": old | new}))
        return self

    def vacuum(self) -> None:
        """Remove what no reader of the current version needs: older manifests and files it doesn't name."""
        keep = set(self.manifest().values())
        current = f"manifest-{self.version()}.json"
        for n in self.files.names(self.path):
            if n.startswith("data-") and f"{self.path}/{n}" not in keep or n.startswith("manifest-") and n != current:
                self.files.remove(f"{self.path}/{n}")

    def state(self) -> DataFrame:
        """(entity_id, field_name, field_value): one row per field that isn't null of each existing entity."""
        return self._read("state", STATE, self.manifest())


#: Bytes of a feed per bucket of its table, and the bounds of their number.
BUCKET_BYTES, FEWEST, MOST = 128 << 20, 16, 1 << 14


def buckets_for(feed: DataFrame) -> int:
    """Buckets for a table of the size of ``feed``, by the planner's estimate: a power of two."""
    size = int(str(feed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # the planner knows nothing
    return max(FEWEST, min(MOST, 1 << (size // BUCKET_BYTES).bit_length()))


def current_state(feed: DataFrame, buckets: int | None = None, loads: int = 1) -> DataFrame:
    """The state after all changes of ``feed``, through a fresh :class:`CowTable`.

    With more ``loads`` than one the feed comes in parts by its order of
    arrival, each part repeating half of the one before, and every part but the
    first is merged into the touched buckets of the table; the state is the same.

    Null or unreadable ``changes`` change nothing; an empty feed gives no rows;
    columns beyond those named in :func:`normalize_feed` are ignored.
    """
    t = CowTable(feed.sparkSession, buckets=buckets or buckets_for(feed))
    if loads == 1:
        return t.apply(feed).state()
    first, last = feed.agg(F.min("feed_seq"), F.max("feed_seq")).first()
    if first is None:
        return t.apply(feed).state()
    step = (last - first) / loads
    for i in range(loads):
        begin, end = first + (i - 0.5) * step, first + (i + 1) * step
        t.apply(feed.where((F.col("feed_seq") >= begin) & (F.col("feed_seq") <= (end if i + 1 < loads else last))))
    return t.state()
