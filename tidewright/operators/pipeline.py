"""The whole way of an upload or feed: records to entities, graph, vectors, review and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..streaming import events as V
from . import entities as X
from . import graph as G
from . import review as R
from . import vectors as E


@dataclass
class Ingested:
    """The frames an ingest gives; each is lazy but for ``entities``, from which all others follow."""

    records: DataFrame
    entities: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    review: DataFrame
    events: DataFrame


def push(spark: SparkSession, rows: list[dict], workspace_id: str, schema_id: str) -> DataFrame:
    """Records a workflow pushes, as a frame (id, workspace_id, schema_id, data); ids follow from content."""
    import json

    df = spark.createDataFrame([(n, json.dumps(r, ensure_ascii=False)) for n, r in enumerate(rows)], "n int, data string")
    return df.select(F.sha2(F.concat_ws("|", F.lit(workspace_id), F.lit(schema_id), F.col("n").cast("string"), "data"), 256).alias("id"), F.lit(workspace_id).alias("workspace_id"), F.lit(schema_id).alias("schema_id"), "data")


def ingest_feed(result, workspace_id: str, job_id: str) -> tuple[DataFrame, DataFrame, Ingested]:
    """(schema, job, ingested) of a connector's answer: a schema without fields, one job, and its rows as records through the pipeline."""
    data, name = result.data, f"connector_{result.name}"
    spark = data.sparkSession
    text = F.to_json(F.struct(*[F.col(c) for c in data.columns]))
    records = materialize(data.select(F.sha2(F.concat_ws("|", F.lit(job_id), text), 256).alias("id"), F.lit(workspace_id).alias("workspace_id"), text.alias("data")), "feed")
    schema = spark.createDataFrame([(workspace_id, name, 1, "active", "[]")], "workspace_id string, name string, version int, status string, fields string")
    job = records.agg(F.count("*").alias("records")).select(F.lit(job_id).alias("job_id"), F.lit("complete").alias("state"), F.lit(name).alias("schema_name"), "records")
    return schema, job, ingest(records, label=f"connector:{result.name}:", job_id=job_id)


def ingest(records: DataFrame, stored: DataFrame | None = None, label: str = "ingestion:", job_id: str = "job") -> Ingested:
    """Run the pipeline over records (id, workspace_id, data[, created_at]).

    Entities are found in every string, deduplicated per workspace (first
    record, key path and pattern win), enriched, merged into ``stored`` if
    given; the rest derives from one written copy of them.  Running it again
    with its own result as ``stored`` changes nothing but last_seen.
    """
    at = F.col("created_at").cast("timestamp_ntz") if "created_at" in records.columns else F.lit(None).cast("timestamp_ntz")
    rows = records.select("id", "workspace_id", at.alias("at"), "data")
    found = X.extract_from_records(rows, "data", "id", "workspace_id", "at", label=label)
    none = F.array().cast("array<string>")
    found = found.withColumns({"source_record_id": F.col("id"), "confidence": F.lit(1.0), "tags": none, "first_seen": F.col("at"), "last_seen": F.col("at")})
    new = X.enrich(X.deduplicate(found, F.struct("at", "id", "source", "seq", "value"), ("workspace_id", "entity_type", "normalized_value")))
    new = new.select(*X.COLUMNS)
    merged = materialize(X.upsert(stored.select(*X.COLUMNS), new) if stored is not None else new, "entities")
    with_id = merged.withColumn("id", F.sha2(F.concat_ws("|", "workspace_id", "entity_type", "normalized_value"), 256))
    vec = with_id.select("id", E.point_id(F.col("id")).alias("point_id"), E.hash_embedding(E.embedding_text(F.col("entity_type"), F.col("value"), F.col("tags"))).alias("embedding"), "workspace_id", "entity_type")
    review = R.gate(with_id.withColumn("item_type", F.lit("entity")).select("id", "workspace_id", "item_type", "confidence"))
    done = records.agg(F.count("*").alias("n"), F.max(at).alias("at")).select(*V.event("ingestion.complete", F.sha2(F.lit(job_id), 256), F.col("at"), F.lit("tidewright"), file_id=F.lit(job_id), record_count=F.col("n")))
    return Ingested(records, merged, G.nodes(with_id, F.col("id")), G.linked(with_id), vec, review, done)
