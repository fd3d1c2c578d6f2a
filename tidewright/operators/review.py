"""Review of uncertain items: gate, queue, decisions, statistics, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses, thresholds by item type and the literal gate. (fixed values)
STATUSES = ("pending", "in_review", "approved", "rejected", "reclassified")
DECIDED = ("approved", "rejected", "reclassified")
THRESHOLDS = {"entity": 0.7, "classification": 0.8, "enrichment": 0.75}
GATE = 0.7


def priority(confidence: Column) -> Column:
    return F.when(confidence < 0.3, "critical").when(confidence < 0.5, "high").when(confidence < 0.7, "medium").otherwise("low")


def threshold(item_type: Column) -> Column:
    out = F.lit(0.7)
    for k, v in THRESHOLDS.items():
        out = F.when(item_type == k, F.lit(v)).otherwise(out)
    return out


def gate(items: DataFrame, confidence: str = "confidence", item_type: str = "item_type", thresholds: DataFrame | None = None, file_name: Column | None = None) -> DataFrame:
    """Items below the gate with priority, threshold and reason; a null confidence isn't uncertain.

    ``thresholds`` (workspace_id, item_type, threshold) overrides the built-in
    ones for its workspaces.  The reason names the file of the ingest if given.
    """
    c = F.col(confidence)
    low = items.where(c < GATE)
    base = threshold(F.col(item_type))
    if thresholds is not None:
        t = thresholds.select("workspace_id", F.col("item_type").alias(item_type), F.col("threshold").alias("_t"))
        low = low.join(t, ["workspace_id", item_type], "left")
        base = F.coalesce("_t", base)
    reason = F.format_string("Low confidence (%.2f)", c)
    if file_name is not None:
        reason = F.concat(reason, F.lit(" during ingestion of "), F.coalesce(file_name, F.lit("")))
    out = low.withColumns({"priority": priority(c), "threshold": base, "reason": reason, "status": F.lit("pending")})
    return out.drop("_t")


def current_status(items: DataFrame, decisions: DataFrame, key: str = "item_id") -> DataFrame:
    """Items with the status of their last decision (item_id, status, decided_at, seq)."""
    last = decisions.groupBy(key).agg(F.max_by("status", F.struct("decided_at", "seq")).alias("_s"))
    return items.join(last, key, "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def assign(decisions: DataFrame, assignments: DataFrame, key: str = "item_id") -> DataFrame:
    """Decisions with assignments (item_id, assignee, decided_at, seq) among them: an item is in review from then on."""
    return decisions.unionByName(assignments.select(key, F.lit("in_review").alias("status"), "decided_at", "seq"))


def stats(items: DataFrame) -> DataFrame:
    """(status, n) of all five statuses, zero where none, and 'total'."""
    domain = items.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    got = items.groupBy("status").agg(F.count("*").alias("n"))
    out = domain.join(got, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return out.unionByName(got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("status"), "n"))


def training_rows(items: DataFrame, start=None, end=None, limit: int = 10_000, at: str = "decided_at", key: str = "item_id") -> DataFrame:
    """Decided items of an inclusive date range, newest first, capped as the interface is."""
    rows = items.where(F.col("status").isin(*DECIDED))
    if start is not None:
        rows = rows.where(F.col(at) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(at) <= F.lit(end))
    return rows.orderBy(F.desc_nulls_last(at), key).limit(limit)


def weighted_confidence(predictions: Column, weights: Column | None = None) -> Column:
    """Weighted mean of two arrays; plain mean without weights or with other lengths, 0 for nothing."""
    n = F.coalesce(F.size(predictions), F.lit(0))
    add = lambda a, x: a + F.coalesce(x, F.lit(0.0))
    mean = F.when(n > 0, F.aggregate(predictions.cast("array<double>"), F.lit(0.0), add) / n).otherwise(0.0)
    if weights is None:
        return mean
    w, p = weights.cast("array<double>"), predictions.cast("array<double>")
    total = F.aggregate(w, F.lit(0.0), add)
    dot = F.aggregate(F.zip_with(p, w, lambda a, b: a * b), F.lit(0.0), add)
    return F.when(weights.isNull() | (F.size(w) != n), mean).when((n == 0) | (total == 0), 0.0).otherwise(F.try_divide(dot, total))
