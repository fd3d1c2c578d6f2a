"""Stores, exports, feeds, windows in streams, metrics, indexes and ranges: queries and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import entities as X
from ..operators import graph as G
from ..operators import pipeline as I
from ..operators import ranges as A
from ..operators import records as R
from ..operators import review as V
from ..operators import schema as S
from ..operators import sinks as K
from ..operators import vectors as E
from ..session import prepare, scratch, table
from ..sources import connectors as N
from ..sources import files as P
from ..sources import objects as O
from ..streaming import events as T
from . import golden, ingest, network

# ---- stores and files ------------------------------------------------------------


def object_store(spark, sf_dir):
    """Objects put into buckets and listed, after one was deleted and an empty bucket dropped."""
    store = O.ObjectStore(prepare(spark), scratch(spark, "objects"))
    store.ensure()
    store.put("raw", O.raw_key("w", "j", "a.csv"), b"a;b\n")
    store.put("reports", "r.json", b"{}")
    store.put("audit", "x", b"gone")
    store.delete("audit", "x")
    store.drop("enriched")
    rows = None
    for b in ("raw", "reports", "audit"):
        part = store.list(b).select(F.lit(b).alias("bucket"), F.regexp_extract("path", f"/{b}/(.*)$", 1).alias("path"), F.col("length").alias("size"))
        rows = part if rows is None else rows.unionByName(part)
    got = [(b, k, store.get(b, k).decode()) for b, k in (("raw", "w/j/a.csv"), ("reports", "r.json"))]
    return rows.join(F.broadcast(spark.createDataFrame(got, "bucket string, path string, content string")), ["bucket", "path"], "left").select("bucket", "path", "size", "content")


def workbook_sheets(spark, sf_dir):
    """Sheets of a workbook by name, with the number of rows read from each."""
    book = P.write_workbook({"Data": (["a"], [["1"], ["2"]]), "Notes": (["n"], [["x"], [None]])})
    base = ingest._write(prepare(spark), {"a.xlsx": book})
    rows = None
    for name in P.sheet_names(book):
        part = P.parse_files(spark, base, sheet=name).groupBy(F.col("source_sheet").alias("sheet")).agg(F.count("data").alias("rows"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


#: Cells of a typed sheet.
SHEET = ({"when": "2025-01-01", "n": 1, "text": "a"}, {"when": "2025-01-02T00:00", "n": 2, "text": "b"}, {"when": None, "n": "3", "text": "7"})


def schema_profile_excel(spark, sf_dir):
    """Types of the columns of a sheet, whose cells are typed already."""
    d = prepare(spark).createDataFrame([(i, json.dumps(r)) for i, r in enumerate(SHEET)], "i int, data string")
    p = S.infer(S.cells_of_json(d, "data", F.col("i")), "excel")
    return p.select("name", "inferred_type", "nullable", F.array_join("sample_values", ",").alias("samples"), F.round("confidence", 6).alias("confidence"))


def workflow_push(spark, sf_dir):
    """Records that a workflow pushes."""
    return I.push(prepare(spark), [{"a": 1}, {"a": None, "b": "ü"}], "w1", "s1").select("workspace_id", "schema_id", "data")


def export_json(spark, sf_dir):
    """Takedowns written as JSON lines and read again, by status; unreadable lines are quarantined."""
    path = scratch(spark, "export")
    K.export(ingest._feed(spark, sf_dir), path, "json")
    good, bad = P.scan_json_lines(spark, path)
    n = good.groupBy(R.text(R.parsed("data"), "status").alias("status")).agg(F.count("*").alias("n"))
    return n.unionByName(bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("(unreadable)").alias("status"), "n"))


def export_excel(spark, sf_dir):
    """The newest takedowns as a workbook, read again, by status."""
    path = scratch(spark, "export") + "/takedowns.xlsx"
    K.export(ingest._feed(spark, sf_dir), path, "excel")
    got = P.parse_files(spark, path.rsplit("/", 1)[0])
    return got.where("data is not null").groupBy(R.text(R.parsed("data"), "status").alias("status")).agg(F.count("*").alias("n"))


# ---- schemas ---------------------------------------------------------------------


def schema_delete(spark, sf_dir):
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    return S.delete(s, s.where("status = 'deprecated'").select("id")).groupBy("name").agg(F.count("*").alias("n"))


def schema_from_inferred(spark, sf_dir):
    """A draft schema after the profile of the customers, its fields spread out."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"), "c_name", F.format_string("%.2f", "c_acctbal").alias("balance"))
    d = S.from_inferred(s, S.infer(S.cells_of_columns(c, F.col("c_custkey"), ["key", "c_name", "balance"])), "w", "customers")
    f = F.from_json("fields", "array<struct<name string, field_type string, nullable boolean, default string, description string>>")
    return d.select("version", "status", F.explode(f).alias("f")).select(F.col("version").cast("bigint").alias("version"), "status", "f.name", "f.field_type", "f.nullable")


# ---- feeds -----------------------------------------------------------------------


class _Busy(N.Connector):
    def fetch(self, spark, query=None):
        raise N.RateLimited("too many requests")


class _Closed(N.Connector):
    def fetch(self, spark, query=None):
        raise OSError("no answer")


def _answers(spark):
    return ingest._write(prepare(spark), {k: json.dumps(v).encode() for k, v in ingest.ANSWERS.items()})


def connector_states(spark, sf_dir):
    """Health of three feeds after a fetch: one answers, one fails, one refuses for now."""
    base = _answers(spark)
    feeds = [N.ScanConnector("scan", base), _Closed("closed", base), _Busy("busy", base)]
    N.fetch_all(spark, feeds)
    return spark.createDataFrame([(h["name"], h["healthy"], h["status"]) for h in (f.health() for f in feeds)], "name string, healthy boolean, status string")


def connector_ingest(spark, sf_dir):
    """A feed through the whole pipeline: its schema, its job, and rows of each kind that come of it."""
    _, job, got = I.ingest_feed(N.TakedownConnector("takedowns", _answers(spark)).fetch(spark), "w", "job-1")
    parts = [job.select(F.lit("job").alias("part"), F.concat_ws(":", "state", "schema_name").alias("kind"), F.col("records").alias("n"))]
    parts += [df.groupBy(F.lit(p).alias("part"), F.col(k).alias("kind")).agg(F.count("*").alias("n")) for p, df, k in (("entities", got.entities, "entity_type"), ("nodes", got.nodes, "label"), ("edges", got.edges, "type"), ("events", got.events, "event_type"))]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


def captured_feed(spark, sf_dir):
    """Captured answers read through the data source, by feed."""
    base = _answers(spark)
    spark.dataSource.register(N.CapturedFeed)
    return spark.read.format("captured").option("paths", ",".join(f"{base}/{f}" for f in sorted(ingest.ANSWERS))).load().groupBy("feed").agg(F.count("*").alias("n"))


def polled_feed(spark, sf_dir):
    """A folder of answers polled as a stream, by feed."""
    base, out = _answers(spark), scratch(spark, "polled")
    spark.dataSource.register(N.CapturedFeed)
    q = spark.readStream.format("captured").option("path", base).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "checkpoint")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("feed string, data string").parquet(out).groupBy("feed").agg(F.count("*").alias("n"))


# ---- events ----------------------------------------------------------------------


def event_types(spark, sf_dir):
    """An event of every type per schema: its subject and the fields of its payload."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    rows = None
    for kind, fields in T.EVENT_FIELDS.items():
        e = s.select(*T.event(kind, F.sha2(F.concat("id", F.lit(kind)), 256), F.col("created_at"), F.lit("engine"), F.col("workspace_id"), **{f: F.lit(f) for f in fields}))
        rows = e if rows is None else rows.unionByName(e)
    keys = F.array_join(F.array_sort(F.json_object_keys("payload")), ",")
    return rows.groupBy("subject", keys.alias("fields")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def event_retention_bytes(spark, sf_dir):
    """What a stream of at most 100 000 bytes keeps."""
    e = table(prepare(spark), sf_dir, "event_messages").withColumn("event_id", F.col("delivery_id"))
    kept = e.join(F.broadcast(e.agg(F.max("timestamp").alias("now"))), F.lit(True))
    return T.retained(kept, F.col("now"), max_bytes=100_000).agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))


def webhook_deliveries(spark, sf_dir):
    """What two subscriptions get of three events."""
    path, out = scratch(prepare(spark), "events"), scratch(spark, "hooks")
    rows = [("1", "entity.created"), ("2", "entity.created"), ("3", "ingestion.complete")]
    e = spark.createDataFrame(rows, "event_id string, event_type string")
    T.publish(e.select("event_id", "event_type", T.subject(F.col("event_type")).alias("subject"), F.lit("2025-01-01").cast("timestamp_ntz").alias("timestamp"), *[F.lit("{}").alias(c) for c in ("source", "correlation_id", "metadata", "payload")]), path)

    def hook(name):
        return lambda batch, n: batch.select(F.lit(name).alias("hook"), F.lit(n).alias("batch"), "event_id", "event_type").write.mode("overwrite").parquet(f"{out}/{name}-{n}")

    hooks = {n: (p, hook(n)) for n, p in (("all", "events.>"), ("entities", "events.entity.*"))}
    for q in T.fan_out(T.subscribe(spark, path), hooks, scratch(spark, "checkpoint")).values():
        q.awaitTermination()
    return spark.read.parquet(f"{out}/*").groupBy("hook", "event_type").agg(F.count("*").alias("n"))


def _streamed(spark, sf_dir):
    """The event table as a stream's folder."""
    path = scratch(prepare(spark), "events")
    e = table(spark, sf_dir, "events")
    e.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("timestamp")).write.parquet(path)
    return spark.readStream.schema("event_id bigint, event_type string, user_id bigint, timestamp timestamp").parquet(path)


def _complete(spark, counts):
    """The last full result of a windowed stream."""
    out = scratch(spark, "out")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_tumbling(spark, sf_dir):
    return _complete(spark, T.tumbling(_streamed(spark, sf_dir), "1 hour", "1 day", "event_type")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sliding(spark, sf_dir):
    return _complete(spark, T.tumbling(_streamed(spark, sf_dir), "2 hours", "1 day", slide="1 hour")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_session(spark, sf_dir):
    return _complete(spark, T.sessions(_streamed(spark, sf_dir), "6 hours", "1 day", "user_id")).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


# ---- metrics and review ------------------------------------------------------------


def request_counters(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "events").select("event_type", F.when(F.col("value") < 0, "500").otherwise("200").alias("status_code"))
    return W.counters(e, "event_type", "status_code")


def active_requests(spark, sf_dir):
    """A gauge of requests under way at the end of each hour, each taking as many minutes as its value."""
    e = table(prepare(spark), sf_dir, "events").select("ts", F.abs("value").cast("int").alias("m"))
    ends = e.select((F.col("ts") + F.make_dt_interval(mins="m")).alias("ts"), F.lit(-1).alias("d"))
    return W.gauge(e.select("ts", F.lit(1).alias("d")).unionByName(ends), "ts", "d").select(F.col("at").alias("hour"), "value")


def review_assign(spark, sf_dir):
    """Items in review once they are assigned, unless they were decided later."""
    from .governance import _decided

    items, d = _decided(spark, sf_dir)
    a = items.where("item_id % 2 = 0").select("item_id", F.lit("ann").alias("assignee"), F.col("received_at").alias("decided_at"), F.lit(0).alias("seq"))
    return V.current_status(items, V.assign(d, a)).select("item_id", "status")


def review_reasons(spark, sf_dir):
    """Reasons that name the file of the job."""
    from .governance import _items

    i = _items(spark, sf_dir).withColumn("file", F.concat(F.lit("file_"), F.col("item_id") % 5, F.lit(".csv")))
    return V.gate(i, file_name=F.col("file")).select("item_id", "reason")


# ---- graph -----------------------------------------------------------------------


def graph_upsert_normal(spark, sf_dir):
    d = prepare(spark).createDataFrame([(" Blue Gull ",), ("ÀB",), ("",)], "raw string")
    return d.select("raw", G.upsert_normal(F.col("raw")).alias("normalized_value"))


def graph_upsert_entity(spark, sf_dir):
    """One entity upserted with three relations, one of them to a node that isn't there."""
    n, e = network._nodes(spark, sf_dir), network._edges(spark, sf_dir)
    new = spark.createDataFrame([("x1", "person", " Ann ", "w")], "id string, entity_type string, value string, workspace_id string")
    rel = spark.createDataFrame([("x1", "n1", None), ("x1", "n2", "RESIDES_AT"), ("x1", "nowhere", None)], "src string, dst string, type string")
    n2, e2, report = G.upsert_with_relations(n, e, new, rel)
    node = n2.where("id = 'x1'").select(F.lit("node").alias("part"), F.concat_ws("|", "label", "normalized_value").alias("what"), F.lit(1).cast("bigint").alias("n"))
    edges = e2.where("src = 'x1'").select(F.lit("edge").alias("part"), F.concat_ws("|", "type", "dst").alias("what"), F.lit(1).cast("bigint").alias("n"))
    return node.unionByName(edges).unionByName(report.select(F.lit("report").alias("part"), F.col("entity_id").alias("what"), F.col("relationship_count").alias("n")))


def graph_export_report(spark, sf_dir):
    """What an export of the requests' entities does, and the edges between those of one workspace day."""
    r = table(prepare(spark), sf_dir, "entity_requests").select(F.col("entity_id").alias("id"), F.nullif(F.trim("entity_type"), F.lit("")).alias("entity_type"), "value", "request_id")
    e = r.where("id is not null").groupBy("id").agg(F.min(F.expr("request_id div 10")).alias("source_record_id"))
    return G.export_report(r, G.linked(e))


# ---- vectors ---------------------------------------------------------------------


def vector_index_report(spark, sf_dir):
    """How many payloads can be embedded."""
    p = table(prepare(spark), sf_dir, "entity_payloads")
    return E.index_report(p, "value")


def vector_delete(spark, sf_dir):
    v = network._vectors(spark, sf_dir).select("vec_id", "label")
    return E.delete(v, v.where("label = 3")).groupBy("label").agg(F.count("*").alias("n"))


def vector_cells(spark, sf_dir):
    """Ten nearest of every hundredth row through the index of cells: whether nine of ten are found, over all queries."""
    v = network._vectors(spark, sf_dir)
    q = v.where("vec_id % 100 = 0")
    found = E.search_cells(v, q, E.fit_cells(v, cells=16), 10, probes=12)
    return E.recall(E.search(v, q, 10), found).select("queries", (F.col("recall") >= 0.9).alias("reached"))


# ---- ranges ----------------------------------------------------------------------


def _bands(spark, sf_dir):
    n = table(prepare(spark), sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 20000.0).alias("lo"), (F.col("n_nationkey") * 20000.0 + 30000.0).alias("hi"))


def z_range_join(spark, sf_dir):
    """Orders by band of their price; bands overlap."""
    o = table(prepare(spark), sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return A.range_join(o, _bands(spark, sf_dir), "o_totalprice", "lo", "hi", 25_000).groupBy("band").agg(F.count("*").alias("n"))


def z_interval_join(spark, sf_dir):
    """Pairs of bands and balances of suppliers, widened, that overlap."""
    s = table(prepare(spark), sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 40 - 500).alias("a"), (F.col("s_acctbal") * 40 + 500).alias("b"))
    return A.interval_join(s, _bands(spark, sf_dir), 10_000, ("a", "b"), ("lo", "hi")).groupBy("band").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (object_store, workbook_sheets, schema_profile_excel, workflow_push, export_json, export_excel, schema_delete, schema_from_inferred, connector_states, connector_ingest, captured_feed, polled_feed,
              event_types, event_retention_bytes, webhook_deliveries, stream_tumbling, stream_sliding, stream_session, request_counters, active_requests, review_assign, review_reasons,
              graph_upsert_normal, graph_upsert_entity, graph_export_report, vector_index_report, vector_delete, vector_cells, z_range_join, z_interval_join)
}

_FEEDS = golden.values("feed n", [("alerts", 2), ("attacks", 1), ("domain", 1), ("entities", 1), ("host", 1), ("info", 1), ("search", 1), ("takedowns", 1)], {"n": "BIGINT"})
_ALL = ingest._AL.format("takedown_feed")
_CUST3 = "cells AS (SELECT ord, unnest(['key', 'c_name', 'balance']) AS name, unnest([c_custkey::VARCHAR, c_name, printf('%.2f', c_acctbal)]) AS v FROM c)"
SQL = {
    "export_json": f"WITH {_ALL} SELECT v->>'status' AS status, count(*) AS n FROM a WHERE json_type(v) = 'OBJECT' GROUP BY ALL UNION ALL SELECT '(unreadable)', count(*) FROM a WHERE data IS NOT NULL AND json_type(v) IS DISTINCT FROM 'OBJECT' HAVING count(*) > 0",
    "export_excel": "WITH a AS (SELECT data FROM data_records WHERE schema_id IN (SELECT id FROM basecamp_schemas WHERE name = 'takedown_feed') ORDER BY created_at DESC NULLS FIRST, id LIMIT 10000), b AS (SELECT CASE WHEN json_valid(data) THEN CASE WHEN json_type(data) = 'VARCHAR' AND json_valid(data->>'$') THEN (data->>'$')::JSON ELSE data::JSON END END AS v FROM a) SELECT nullif(trim(v->>'status'), '') AS status, count(*) AS n FROM b WHERE json_type(v) = 'OBJECT' GROUP BY ALL",
    "schema_delete": "SELECT name, count(*) AS n FROM basecamp_schemas WHERE status IS DISTINCT FROM 'deprecated' GROUP BY ALL",
    "schema_from_inferred": f"WITH {ingest._CUST}, {_CUST3}{ingest._INFER} SELECT 1::BIGINT AS version, 'draft' AS status, name, inferred_type AS field_type, nullable FROM prof",
    "captured_feed": _FEEDS,
    "polled_feed": _FEEDS,
    "event_types": " UNION ALL ".join(f"SELECT 'events.{k}' AS subject, '{','.join(sorted(f))}' AS fields, count(*) AS n, count(DISTINCT id) AS ids FROM basecamp_schemas" for k, f in T.EVENT_FIELDS.items()),
    "event_retention_bytes": "WITH k AS (SELECT delivery_id, payload, timestamp FROM event_messages WHERE timestamp >= (SELECT max(timestamp) FROM event_messages) - INTERVAL 7 DAYS ORDER BY timestamp DESC, delivery_id LIMIT 100000), s AS (SELECT *, sum(coalesce(strlen(payload), 0)) OVER (ORDER BY timestamp DESC, delivery_id ROWS UNBOUNDED PRECEDING) AS size FROM k) SELECT count(*) AS n, sum(strlen(payload))::BIGINT AS bytes FROM s WHERE size <= 100000",
    "request_counters": "SELECT event_type, CASE WHEN value < 0 THEN '500' ELSE '200' END AS status_code, count(*) AS n FROM events GROUP BY ALL",
    "active_requests": "WITH x AS (SELECT ts, 1 AS d FROM events UNION ALL SELECT ts + to_minutes(trunc(abs(value))::BIGINT), -1 FROM events), h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, sum(d) AS d FROM x GROUP BY ALL) SELECT hour, (sum(d) OVER (ORDER BY hour))::BIGINT AS value FROM h",
    "review_assign": "SELECT request_id AS item_id, CASE WHEN request_id % 3 = 0 THEN CASE WHEN request_id % 2 = 0 THEN 'in_review' ELSE 'pending' END WHEN request_id % 5 = 0 THEN 'reclassified' WHEN request_id % 3 = 1 THEN 'approved' ELSE 'rejected' END AS status FROM entity_requests WHERE confidence < 0.7",
    "review_reasons": "SELECT request_id AS item_id, printf('Low confidence (%s) during ingestion of file_%d.csv', round(confidence::DECIMAL(18,6), 2)::DECIMAL(10,2)::VARCHAR, request_id % 5) AS reason FROM entity_requests WHERE confidence < 0.7",
    "graph_export_report": f"WITH d AS (SELECT entity_id AS id, min(request_id // 10) AS r FROM entity_requests WHERE entity_id IS NOT NULL GROUP BY ALL), e AS (SELECT count(*) AS c FROM d a JOIN d b ON a.r = b.r AND a.id < b.id) SELECT count(*) FILTER (entity_id IS NOT NULL AND trim(entity_type) <> '' AND value IS NOT NULL) AS entities_exported, count(*) FILTER (NOT coalesce(entity_id IS NOT NULL AND trim(entity_type) <> '' AND value IS NOT NULL, false)) AS errors, any_value(c) AS relationships_created FROM entity_requests, e",
    "graph_upsert_entity": golden.values("part what n", [("node", "Person|ann", 1), ("edge", "RELATED_TO|n1", 1), ("edge", "RESIDES_AT|n2", 1), ("report", "x1", 2)], {"n": "BIGINT"}),
    "vector_index_report": "SELECT count(*) FILTER (trim(value) <> '') AS indexed, count(*) FILTER (NOT coalesce(trim(value) <> '', false)) AS failed FROM entity_payloads",
    "vector_delete": "SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY ALL",
    "vector_cells": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0",
    "z_range_join": "SELECT n_nationkey AS band, count(*) AS n FROM orders JOIN nation ON o_totalprice BETWEEN n_nationkey * 20000.0 AND n_nationkey * 20000.0 + 30000.0 GROUP BY ALL",
    "z_interval_join": "SELECT n_nationkey AS band, count(*) AS n FROM supplier JOIN nation ON s_acctbal * 40 - 500 <= n_nationkey * 20000.0 + 30000.0 AND n_nationkey * 20000.0 <= s_acctbal * 40 + 500 GROUP BY ALL",
    **{k: golden.SQL[k] for k in ("object_store", "workbook_sheets", "schema_profile_excel", "workflow_push", "connector_states", "connector_ingest", "webhook_deliveries", "graph_upsert_normal")},
}
