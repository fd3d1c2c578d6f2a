"""Queries of the text problems (1, 7, 8, 9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, spread, table
from . import bytebpe, formatting, packing, spam


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "entity_requests").select(F.col("request_id").alias("id"), F.col("entity_type").alias("kind"), "value")
    b = table(spark, sf_dir, "entity_payloads").select(F.col("payload_id").alias("id"), F.col("type").alias("kind"), "value")
    return spread(a).unionByName(spread(b))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ from an earlier one in formatting only: (first_id, copy_id)."""
    return formatting.hidden_copies(_records(prepare(spark), sf_dir))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once with the number of its copies: (first_id, copies)."""
    return formatting.collapsed(_records(prepare(spark), sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, ids)."""
    return bytebpe.encode(_documents(spark, sf_dir))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of every capacity: (pack_name, container_id, doc_id, part, start_token, n_tokens)."""
    return packing.pack_texts(_documents(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack: documents packed, whether no container exceeds the capacity, and whether no document that fits is cut: (pack_name, docs, fits, whole)."""
    packs = table(prepare(spark), sf_dir, "pack_sizes").select("pack_name", F.col("capacity").alias("room"))
    rows = p8_packed(spark, sf_dir)
    load = rows.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("load")).groupBy("pack_name").agg(F.max("load").alias("load"))
    docs = rows.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts")).join(F.broadcast(packs), "pack_name")
    whole = F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("room")))
    docs = docs.groupBy("pack_name", "room").agg(F.count("*").alias("docs"), F.bool_and(whole).alias("whole"))
    return docs.join(load, "pack_name").select("pack_name", "docs", (F.col("load") <= F.col("room")).alias("fits"), "whole")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made for attention: (doc_id)."""
    return spam.spam_pages(_documents(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_totals": p8_totals, "p9_found": p9_found}
SQL: dict[str, str] = {"p8_totals": "SELECT pack_name, count(DISTINCT doc_id) AS docs, true AS fits, true AS whole FROM documents, pack_sizes GROUP BY ALL"}
