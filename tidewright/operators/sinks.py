"""Exports, loads and the job ledger."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import read_plain
from ..sources.files import write_xlsx
from . import records as R


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, on whatever file system Spark uses."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        s.write(bytearray(content))
    finally:
        s.close()


def load_records(records: DataFrame, path: str, *by: str) -> None:
    """Append records to a lake folder, partitioned by columns of few values."""
    records.write.mode("append").partitionBy(*by).parquet(path)


def export_rows(df: DataFrame, key: str = "id", cap: int | None = R.EXPORT_CAP) -> DataFrame:
    """The rows of an export: the newest ``cap`` rows, then by key, as the interface is; all rows unordered with None."""
    if cap is None:
        return df
    order = [F.col("created_at").desc_nulls_first()] if "created_at" in df.columns else []
    return df.orderBy(*order, key).limit(cap)


def export_columns(df: DataFrame, data: str = "data") -> list[str]:
    """The sorted union of the fields: one name per column of the export."""
    return sorted(r[0] for r in R.field_names(df, data).select("field_name").collect())


def flat(df: DataFrame, data: str = "data") -> DataFrame:
    """One text column per field of the union, '' where a record lacks it."""
    cols = export_columns(df, data)
    v = df.withColumn("_v", R.parsed(data))
    return v.select(*[F.coalesce(R.text(F.col("_v"), c), F.lit("")).alias(c) for c in cols])


def export(df: DataFrame, path: str, kind: str, data: str = "data") -> None:
    """Write an export: json (lines), csv, parquet as folders; ``json array`` and excel as one file of a capped, collected frame."""
    rows = export_rows(df, cap=R.EXPORT_CAP if kind == "excel" else None)
    if kind == "json":
        # Raw line breaks in JSON are layout; a record is one line.
        rows.where(F.col(data).isNotNull()).select(F.regexp_replace(data, r"[\r\n]+", " ").alias(data)).write.mode("overwrite").text(path)
    elif kind == "json array":
        got = [d for d in (read_plain(r[0]) for r in export_rows(df).select(data).collect()) if d is not None]
        write_file(df.sparkSession, path, json.dumps(got, ensure_ascii=False, indent=2).encode())
    elif kind == "csv":
        flat(rows, data).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    elif kind == "parquet":
        flat(rows, data).write.mode("overwrite").parquet(path)
    elif kind == "excel":
        got = [d for d in (read_plain(r[0]) for r in rows.select(data).collect()) if isinstance(d, dict)]
        cols = sorted({k for d in got for k in d})
        write_file(df.sparkSession, path, write_xlsx(cols, [[("" if d.get(c) is None else str(d[c])) for c in cols] for d in got]))
    else:
        raise ValueError(f"unknown export format {kind!r}")


#: States of an ingest in order. (fixed values)
STATES = ("received", "analyzing", "validating", "transforming", "loading", "complete", "failed")


def job_ledger(transitions: DataFrame) -> DataFrame:
    """Last state of every job (job_id, state, at, records) from its transitions; counters add up."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return transitions.groupBy("job_id").agg(F.max_by("state", F.struct("at", rank)).alias("state"), F.max("at").alias("at"), F.sum("records").alias("records"))


def auto_schema_name(file: str, job_id: str) -> str:
    stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"auto_{stem}_{job_id[:8]}"
