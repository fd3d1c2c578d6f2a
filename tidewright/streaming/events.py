"""Events as streams: envelopes, subjects, publish, subscribe, once-only, windows, retention."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event types with the fields beyond the envelope, families, and retention limits. (fixed values)
EVENT_FIELDS = {
    "ingestion.complete": ("file_id", "file_name", "record_count", "schema_id", "bucket", "duration_ms"),
    "ingestion.failed": ("file_name", "error_message", "error_type"),
    "enrichment.complete": ("entity_id", "entity_type", "enrichment_sources", "fields_enriched", "confidence_score"),
    "enrichment.failed": ("entity_id", "entity_type", "error_message", "source"),
    "entity.created": ("entity_id", "entity_type", "entity_data", "created_by"),
    "entity.updated": ("entity_id", "entity_type", "changes", "updated_by"),
    "entity.deleted": ("entity_id", "entity_type", "deleted_by"),
    "connector.fetch": ("connector_type", "query", "results_count", "target_entity_id", "rate_limit_remaining"),
    "connector.error": ("connector_type", "query", "error_message", "is_rate_limited"),
}
FAMILIES = ("ingestion", "enrichment", "entity", "connector")
PREFIX = "events"
MAX_MESSAGES, MAX_BYTES, MAX_AGE_DAYS = 100_000, 512 * 2**20, 7

ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "event_type", "subject")] + [T.StructField("timestamp", T.TimestampNTZType())] + [T.StructField(n, T.StringType()) for n in ("source", "correlation_id", "metadata", "payload")])


def subject(event_type: Column, prefix: str = PREFIX) -> Column:
    """Subject of an event type; a deployment's own prefix can be given."""
    return F.concat(F.lit(prefix + "."), event_type)


def subject_matches(col: Column, pattern: str) -> Column:
    """Whether a subject fits a pattern with ``*`` for one part and ``>`` for the rest."""
    rx = ".".join(p for p in pattern.split("."))
    rx = re.escape(rx).replace(r"\*", r"[^.]+").replace(r"\.>", r"\..+").replace(">", ".+")
    return col.rlike(f"^{rx}$")


def event(event_type: str, event_id: Column, timestamp: Column, source: Column, correlation_id: Column | None = None, /, **fields: Column) -> list[Column]:
    """Columns of a typed event; a field its type doesn't have is an error."""
    unknown = set(fields) - set(EVENT_FIELDS[event_type])
    if unknown:
        raise ValueError(f"{event_type} has no {sorted(unknown)}")
    none = F.lit(None).cast("string")
    payload = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())])) if fields else F.lit("{}")
    vals = (event_id, F.lit(event_type), subject(F.lit(event_type)), timestamp.cast("timestamp_ntz"), source, correlation_id if correlation_id is not None else none, F.lit("{}"), payload)
    return [v.alias(f.name) for v, f in zip(vals, ENVELOPE.fields)]


def publish(df: DataFrame, path: str) -> None:
    """Append events to the stream's folder."""
    df.select(*ENVELOPE.fieldNames()).write.mode("append").json(path)


def subscribe(spark: SparkSession, path: str, pattern: str = f"{PREFIX}.>", files_per_trigger: int | None = None) -> DataFrame:
    """A streaming frame of the events whose subject fits; delivery is at least once per checkpoint."""
    r = spark.readStream.schema(ENVELOPE)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(path).where(subject_matches(F.col("subject"), pattern))


def once(events: DataFrame, late: str = "1 day", key: str = "event_id", time: str = "timestamp") -> DataFrame:
    """One event per id as long as copies come within ``late``; state is dropped beyond that."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def once_stored(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", buckets: int = 64):
    """A query that appends each event to ``path`` once, however late a copy comes; runs on what is there and stops.

    Stateless: what was seen lies below ``path`` by bucket of the id, and a
    batch reads the ids of the buckets it touches.  A batch that is repeated
    replaces what it wrote.  Events without an id all stay.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def handle(batch, n):
        rows = batch.withColumn("bucket", bucket)
        named = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
        if n:
            seen = spark.read.schema(schema).parquet(path).where(F.col("batch") < n).select(key, "bucket")
            named = named.join(seen, [key, "bucket"], "left_anti").select(*rows.columns)
        named.unionByName(rows.where(F.col(key).isNull())).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={n}")

    return poll(stream, handle, checkpoint, once_only=True)


def tumbling(events: DataFrame, size: str, late: str, *by: str, time: str = "timestamp", slide: str | None = None) -> DataFrame:
    """Counts per window (tumbling, or sliding with ``slide``) and ``by``; rows later than ``late`` are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, late: str, *by: str, time: str = "timestamp") -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def retained(events: DataFrame, now: Column, max_messages: int = MAX_MESSAGES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Events a stream keeps: of the last seven days, the newest so many, as long as their payloads don't exceed ``max_bytes`` together."""
    young = events.where(F.col("timestamp") >= now - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS"))
    newest = young.orderBy(F.desc("timestamp"), "event_id").limit(max_messages)
    # The running sum is over at most ``max_messages`` rows.
    size = F.sum(F.coalesce(F.octet_length("payload"), F.lit(0))).over(Window.orderBy(F.desc("timestamp"), "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("_size", size).where(F.col("_size") <= max_bytes).drop("_size")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; started again, only what is new."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def fan_out(stream: DataFrame, sinks: dict[str, tuple[str, object]], checkpoint: str):
    """One query per subscription: (pattern, function of (batch frame, batch id)); handles by name.

    The functions stand for webhooks: they get each batch at least once and
    must bear a repetition.
    """
    out = {}
    for name, (pattern, f) in sinks.items():
        part = stream.where(subject_matches(F.col("subject"), pattern))
        out[name] = part.writeStream.foreachBatch(f).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return out


def poll_patiently(stream, handle, checkpoint: str, interval_s: int = 3600, back_off_s: int = 60, polls: int | None = None, sleep=time.sleep) -> int:
    """Poll again and again: ``stream()`` gives the feed's frame; after an error the next poll waits ``back_off_s``.

    ``polls`` ends the loop after so many polls; the number that failed is
    returned.  What a failed poll left undone is done by the next one.
    """
    failed = n = 0
    while polls is None or n < polls:
        n += 1
        try:
            poll(stream(), handle, checkpoint, once_only=True).awaitTermination()
            wait = interval_s
        except Exception:  # the feed may be back at the next poll
            failed, wait = failed + 1, back_off_s
        if polls is None or n < polls:
            sleep(wait)
    return failed


def poll(stream: DataFrame, handle, checkpoint: str, interval_s: int = 3600, once_only: bool = False):
    """Run a pipeline on every new batch of a polled feed, each hour unless said otherwise."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once_only else w.trigger(processingTime=f"{interval_s} seconds")).start()
