"""Compliance, review, request and file queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import compliance as C
from ..operators import review as V
from ..session import prepare, table

_SIGNED = ["id", "timestamp", "action", "resource_type", "user_id", "details"]


def _log(spark, sf_dir):
    """The event table as an audit log."""
    e = table(prepare(spark), sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.concat(F.lit("r"), F.pmod("user_id", F.lit(7)).cast("string")).alias("resource_type"), "user_id", F.col("props").alias("details"))


def _signed(spark, sf_dir):
    """The log with checksums, of which every seventeenth row was tampered with afterwards."""
    s = C.log_action(_log(spark, sf_dir), _SIGNED)
    return s.withColumn("details", F.when(F.col("id") % 17 == 0, F.lit('{"k":-1}')).otherwise(F.col("details")))


def audit_by_action(spark, sf_dir):
    return C.by_action(_log(spark, sf_dir))


def audit_by_resource(spark, sf_dir):
    return C.by_resource(_log(spark, sf_dir))


def audit_top_users(spark, sf_dir):
    return C.top_users(_log(spark, sf_dir))


def audit_hourly(spark, sf_dir):
    return C.hourly(_log(spark, sf_dir))


def audit_summary(spark, sf_dir):
    return C.summary(_log(spark, sf_dir))


def audit_checksums(spark, sf_dir):
    return C.log_action(_log(spark, sf_dir), _SIGNED).select("id", "checksum")


def audit_integrity(spark, sf_dir):
    return C.integrity(_signed(spark, sf_dir), _SIGNED)


def audit_offenders(spark, sf_dir):
    return C.verify(_signed(spark, sf_dir), _SIGNED).where("not valid").select("id")


def audit_export_hash(spark, sf_dir):
    return C.export_checksum(C.log_action(_log(spark, sf_dir), _SIGNED), "id")


def audit_report(spark, sf_dir):
    return C.report(_signed(spark, sf_dir), _SIGNED)


def audit_log_page(spark, sf_dir):
    return _log(spark, sf_dir).where("action = 'click'").orderBy(F.desc("timestamp"), "id").limit(100).select("id", "user_id")


def lineage_ancestors(spark, sf_dir):
    """Ancestors of every part, the parent of a part being half its key."""
    p = table(prepare(spark), sf_dir, "part")
    return C.ancestors(p.select(F.col("p_partkey").alias("record_id"), F.expr("nullif(p_partkey div 2, 0)").alias("parent_record_id")))


def lineage_entries(spark, sf_dir):
    """Lineage rows of records: from their job, ids by content."""
    r = table(prepare(spark), sf_dir, "data_records")
    return r.select(*C.track(F.col("id"), F.lit("file"), F.col("ingestion_job_id")))


# ---- review -------------------------------------------------------------------


def _items(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "entity_requests")
    kind = F.element_at(F.array(*map(F.lit, ("entity", "classification", "enrichment", "other"))), (F.col("request_id") % 4 + 1).cast("int"))
    return e.select(F.col("request_id").alias("item_id"), "workspace_id", "confidence", kind.alias("item_type"), "received_at")


def _decided(spark, sf_dir):
    items = V.gate(_items(spark, sf_dir))
    d = items.where(F.col("item_id") % 3 != 0).select("item_id", F.element_at(F.array(*map(F.lit, V.STATUSES[1:4])), (F.col("item_id") % 3 + 1).cast("int")).alias("status"), F.col("received_at").alias("decided_at"), F.lit(1).alias("seq"))
    later = d.where(F.col("item_id") % 5 == 0).select("item_id", F.lit("reclassified").alias("status"), (F.col("decided_at") + F.expr("INTERVAL 1 HOUR")).alias("decided_at"), F.lit(2).alias("seq"))
    return items, d.unionByName(later)


def review_gate(spark, sf_dir):
    return V.gate(_items(spark, sf_dir)).select("item_id", "priority", F.col("threshold").cast("double").alias("threshold"), "reason")


def review_priority(spark, sf_dir):
    return _items(spark, sf_dir).where("confidence is not null").groupBy(V.priority(F.col("confidence")).alias("priority"), "item_type").agg(F.count("*").alias("n"))


def review_queue(spark, sf_dir):
    q = V.gate(_items(spark, sf_dir)).where("priority = 'high' and item_type = 'entity'")
    return q.orderBy(F.desc("received_at"), "item_id").limit(100).select("item_id", "priority")


def review_status(spark, sf_dir):
    return V.current_status(*_decided(spark, sf_dir)).select("item_id", "status")


def review_stats_zero_fill(spark, sf_dir):
    return V.stats(V.gate(_items(spark, sf_dir)))


def review_stats(spark, sf_dir):
    return V.stats(V.current_status(*_decided(spark, sf_dir)))


def review_training_data(spark, sf_dir):
    items, d = _decided(spark, sf_dir)
    rows = V.current_status(items, d).withColumn("decided_at", F.col("received_at"))
    return V.training_rows(rows).select("item_id", "status", "item_type")


def review_weighted_confidence(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    p = F.array("l_discount", "l_tax", F.lit(0.5))
    w = F.when(F.col("l_quantity") > 10, F.array("l_quantity", F.lit(1.0), F.lit(2.0))).when(F.col("l_quantity") > 5, F.array(F.lit(1.0)))
    return e.groupBy("l_orderkey").agg(F.round(F.sum(V.weighted_confidence(p, w)), 6).alias("confidence"))


def review_thresholds(spark, sf_dir):
    """The gate with one workspace's own thresholds."""
    i = _items(spark, sf_dir)
    t = i.groupBy("workspace_id", "item_type").agg(F.min("item_id").alias("m")).where("m % 2 = 0").select("workspace_id", "item_type", F.lit(0.9).alias("threshold"))
    return V.gate(i, thresholds=t).groupBy("item_type", F.col("threshold").cast("double").alias("threshold")).agg(F.count("*").alias("n"))


# ---- requests and files ---------------------------------------------------------


def _paths(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents").where("url is not null")
    return d.select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, ("/api", "/api/compliance/report", "/health", ""))), (F.col("doc_id") % 4 + 1).cast("int")), F.regexp_extract("url", "https?://[^/]+(.*)", 1)).alias("path"))


def path_normalize(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(W.normalize_path(F.col("path")).alias("route")).agg(F.count("*").alias("n"))


def resource_from_path(spark, sf_dir):
    r = _paths(spark, sf_dir).select("doc_id", W.resource(F.col("path")).alias("r"))
    return r.select("doc_id", "r.resource_type", "r.resource_id")


def path_audited(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", W.audited(F.col("path")).alias("audited"))


def method_action(spark, sf_dir):
    m = F.element_at(F.array(*map(F.lit, ("GET", "post", "PUT", "PATCH", "DELETE", "OPTIONS"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(prepare(spark), sf_dir, "events").groupBy(W.action(m).alias("action")).agg(F.count("*").alias("n"))


def client_ips(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("doc_id") % 200, F.lit(" , 10.1.1.1"))).alias("fwd"), F.when(F.col("doc_id") % 3 == 1, F.lit("10.2.2.2")).alias("real"))
    return d.groupBy(W.client_ip(F.col("fwd"), F.when(F.col("doc_id") % 2 == 0, "peer"), F.col("real")).alias("ip")).agg(F.count("*").alias("n"))


def query_kind(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "entity_requests").where("value is not null")
    k = F.when(W.is_ip(F.col("value")), "ip").when(W.is_domain(F.col("value")), "domain").otherwise("search")
    return e.select("request_id", k.alias("kind"))


def request_histogram(spark, sf_dir):
    """Cumulative latency buckets per event type, as a metrics endpoint shows them."""
    e = table(prepare(spark), sf_dir, "events").select("event_type", (F.abs("value") / 10).alias("s"))
    n = e.groupBy("event_type").agg(*[F.count_if(F.col("s") <= b).alias(f"b{i}") for i, b in enumerate(W.BUCKETS)])
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(W.BUCKETS)])).alias("x")
    return n.select("event_type", pairs).select("event_type", "x.le", "x.n")


def job_ages(spark, sf_dir):
    j = table(prepare(spark), sf_dir, "ingestion_jobs")
    last = j.agg((F.max("created_at") + F.expr("INTERVAL 30 SECONDS")).alias("now"))
    return j.join(F.broadcast(last), F.lit(True)).select("id", W.time_ago(F.col("created_at"), F.col("now")).alias("age"))


def file_sizes(spark, sf_dir):
    return table(prepare(spark), sf_dir, "ingestion_jobs").select("id", W.file_size(F.col("file_size")).alias("size"))


def file_mime(spark, sf_dir):
    return table(prepare(spark), sf_dir, "ingestion_jobs").where("file_name is not null").groupBy(W.mime(F.col("file_name")).alias("mime")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (audit_by_action, audit_by_resource, audit_top_users, audit_hourly, audit_summary, audit_checksums, audit_integrity, audit_offenders, audit_export_hash, audit_report, audit_log_page, lineage_ancestors, lineage_entries,
              review_gate, review_priority, review_queue, review_status, review_stats_zero_fill, review_stats, review_training_data, review_weighted_confidence, review_thresholds,
              path_normalize, resource_from_path, path_audited, method_action, client_ips, query_kind, request_histogram, job_ages, file_sizes, file_mime)
}

# ---- SQL ------------------------------------------------------------------

_L = "l AS (SELECT event_id AS id, ts AS timestamp, event_type AS action, 'r' || (user_id % 7)::VARCHAR AS resource_type, user_id, props AS details FROM events)"


def _sha(details: str = "details") -> str:
    """The checksum of all six signed fields, by name, with the given details."""
    cols = {"action": "action", "details": details, "id": "id", "resource_type": "resource_type", "timestamp": "timestamp", "user_id": "user_id"}
    return "sha256(concat_ws(', ', " + ", ".join(f"'{k}=' || coalesce('''' || replace({c}::VARCHAR, '''', '''''') || '''', 'null')" for k, c in cols.items()) + "))"


_C = _sha()
#: A row fails if the checksum of what is stored now isn't the one that was signed.
_OFF = "(" + _C + " <> " + _sha("(CASE WHEN id % 17 = 0 THEN '{\"k\":-1}' ELSE details END)") + ")"
_PR = "CASE WHEN confidence < 0.3 THEN 'critical' WHEN confidence < 0.5 THEN 'high' WHEN confidence < 0.7 THEN 'medium' ELSE 'low' END"
_I = "i AS (SELECT request_id AS item_id, workspace_id, confidence, (['entity', 'classification', 'enrichment', 'other'])[request_id % 4 + 1] AS item_type, received_at FROM entity_requests), q AS (SELECT * FROM i WHERE confidence < 0.7)"
_TH = "CASE item_type WHEN 'classification' THEN 0.8 WHEN 'enrichment' THEN 0.75 ELSE 0.7 END::DOUBLE"
_ST = "s AS (SELECT item_id, item_type, received_at, CASE WHEN item_id % 3 = 0 THEN 'pending' WHEN item_id % 5 = 0 THEN 'reclassified' WHEN item_id % 3 = 1 THEN 'approved' ELSE 'rejected' END AS status FROM q)"
_STATS = "SELECT d.status, count(s.item_id) AS n FROM (SELECT unnest(['pending', 'in_review', 'approved', 'rejected', 'reclassified']) AS status) d LEFT JOIN {t} s ON d.status = s.status GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM {t}"
_PA = "p AS (SELECT doc_id, (['/api', '/api/compliance/report', '/health', ''])[doc_id % 4 + 1] || regexp_extract(url, 'https?://[^/]+(.*)', 1) AS path FROM documents WHERE url IS NOT NULL)"
_PARTS = "t AS (SELECT doc_id, string_split(trim(path, '/'), '/') AS x FROM p), u AS (SELECT doc_id, CASE WHEN x[1] = 'api' THEN x[2:] ELSE x END AS x FROM t)"
_WC = "CASE WHEN l_quantity > 10 THEN CASE WHEN l_quantity + 3 = 0 THEN 0 ELSE (l_discount * l_quantity + l_tax + 1.0) / (l_quantity + 3) END ELSE (l_discount + l_tax + 0.5) / 3 END"
SQL = {
    "audit_by_action": f"WITH {_L} SELECT action, count(*) AS n FROM l GROUP BY ALL",
    "audit_by_resource": f"WITH {_L} SELECT resource_type, count(*) AS n FROM l GROUP BY ALL",
    "audit_top_users": f"WITH {_L} SELECT user_id, count(*) AS n FROM l WHERE user_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10",
    "audit_hourly": f"WITH {_L} SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(*) AS n FROM l GROUP BY ALL",
    "audit_summary": f"WITH {_L} SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(DISTINCT resource_type) AS unique_resources FROM l",
    "audit_checksums": f"WITH {_L} SELECT id, {_C} AS checksum FROM l",
    "audit_integrity": f"WITH {_L} SELECT count(*) AS total, count(*) FILTER (NOT {_OFF}) AS valid, count(*) FILTER ({_OFF}) AS invalid, coalesce(bool_and(NOT {_OFF}), true) AS verified FROM l",
    "audit_offenders": f"WITH {_L} SELECT id FROM l WHERE {_OFF}",
    "audit_export_hash": f"""WITH {_L}, r AS (SELECT {_C} AS c, id::VARCHAR AS k, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT n, sha256(concat_ws(':', c, k, n::VARCHAR)) AS h FROM r),
        f AS (SELECT left(h, 6) AS b, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM x GROUP BY ALL), g AS (SELECT left(b, 3) AS b, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM f GROUP BY ALL)
        SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS export_checksum FROM g""",
    "audit_report": f"""WITH {_L}, u AS (SELECT user_id, count(*) AS n FROM l WHERE user_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, user_id LIMIT 10)
        SELECT 'action' AS section, action AS key, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'resource', resource_type, count(*) FROM l GROUP BY ALL UNION ALL SELECT 'user', user_id::VARCHAR, n FROM u
        UNION ALL SELECT 'hour', strftime(timestamp, '%Y-%m-%d %H:00') AS h, count(*) FROM l GROUP BY ALL UNION ALL SELECT 'total', 'events', count(*) FROM l
        UNION ALL SELECT 'integrity', 'valid', count(*) FILTER (NOT {_OFF}) FROM l UNION ALL SELECT 'integrity', 'invalid', count(*) FILTER ({_OFF}) FROM l""",
    "audit_log_page": f"WITH {_L} SELECT id, user_id FROM l WHERE action = 'click' ORDER BY timestamp DESC, id LIMIT 100",
    "lineage_ancestors": "WITH RECURSIVE e AS (SELECT p_partkey AS r, p_partkey // 2 AS p FROM part WHERE p_partkey // 2 > 0), up AS (SELECT r, p, 1 AS d FROM e UNION ALL SELECT up.r, e.p, d + 1 FROM up JOIN e ON up.p = e.r) SELECT r::VARCHAR AS record_id, p::VARCHAR AS ancestor_id, min(d)::INT AS depth FROM up GROUP BY ALL",
    "lineage_entries": "SELECT sha256(concat_ws('|', id, 'file', ingestion_job_id)) AS id, id AS record_id, 'file' AS source_type, ingestion_job_id AS parent_record_id FROM data_records",
    "review_gate": f"WITH {_I} SELECT item_id, {_PR} AS priority, {_TH} AS threshold, printf('Low confidence (%s)', round(confidence::DECIMAL(18,6), 2)::DECIMAL(10,2)::VARCHAR) AS reason FROM q",
    "review_priority": f"WITH {_I} SELECT {_PR} AS priority, item_type, count(*) AS n FROM i WHERE confidence IS NOT NULL GROUP BY ALL",
    "review_queue": f"WITH {_I} SELECT item_id, {_PR} AS priority FROM q WHERE item_type = 'entity' AND {_PR} = 'high' ORDER BY received_at DESC, item_id LIMIT 100",
    "review_status": f"WITH {_I}, {_ST} SELECT item_id, status FROM s",
    "review_stats_zero_fill": f"WITH {_I}, z AS (SELECT item_id, 'pending' AS status FROM q) {_STATS.format(t='z')}",
    "review_stats": f"WITH {_I}, {_ST} {_STATS.format(t='s')}",
    "review_training_data": f"WITH {_I}, {_ST} SELECT item_id, status, item_type FROM s WHERE status IN ('approved', 'rejected', 'reclassified') ORDER BY received_at DESC NULLS LAST, item_id LIMIT 10000",
    "review_weighted_confidence": f"SELECT l_orderkey, round(sum({_WC}), 6) AS confidence FROM lineitem GROUP BY ALL",
    "review_thresholds": f"WITH {_I}, t AS (SELECT workspace_id, item_type FROM i GROUP BY ALL HAVING min(item_id) % 2 = 0) SELECT q.item_type, CASE WHEN t.item_type IS NOT NULL THEN 0.9 ELSE CASE q.item_type WHEN 'classification' THEN 0.8 WHEN 'enrichment' THEN 0.75 ELSE 0.7 END END::DOUBLE AS threshold, count(*) AS n FROM q LEFT JOIN t ON q.workspace_id = t.workspace_id AND q.item_type = t.item_type GROUP BY ALL",
    "path_normalize": f"WITH {_PA} SELECT array_to_string(list_transform(string_split(path, '/'), lambda x: CASE WHEN regexp_full_match(x, '(?i)[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}|[0-9]+') THEN '{{id}}' ELSE x END), '/') AS route, count(*) AS n FROM p GROUP BY ALL",
    "resource_from_path": f"WITH {_PA}, {_PARTS} SELECT doc_id, coalesce(x[1], 'unknown') AS resource_type, CASE WHEN x[2] <> '' AND NOT starts_with(x[2], '_') THEN x[2] END AS resource_id FROM u",
    "path_audited": f"WITH {_PA} SELECT doc_id, NOT (" + " OR ".join(f"starts_with(path, '{x}')" for x in W.EXCLUDED) + ") AS audited FROM p",
    "method_action": "SELECT (['read', 'create', 'update', 'update', 'delete', 'read'])[event_id % 6 + 1] AS action, count(*) AS n FROM events GROUP BY ALL",
    "client_ips": "SELECT CASE WHEN doc_id % 3 = 0 THEN '10.0.0.' || (doc_id % 200)::VARCHAR WHEN doc_id % 3 = 1 THEN '10.2.2.2' WHEN doc_id % 2 = 0 THEN 'peer' ELSE 'unknown' END AS ip, count(*) AS n FROM documents GROUP BY ALL",
    "query_kind": r"SELECT request_id, CASE WHEN regexp_full_match(value, '\d{1,3}(\.\d{1,3}){3}') THEN 'ip' WHEN regexp_full_match(value, '[a-zA-Z0-9][-a-zA-Z0-9]*(\.[a-zA-Z0-9][-a-zA-Z0-9]*)+') THEN 'domain' ELSE 'search' END AS kind FROM entity_requests WHERE value IS NOT NULL",
    "request_histogram": "SELECT event_type, le, count(*) FILTER (abs(value) / 10 <= le) AS n FROM events, (SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in W.BUCKETS) + "]) AS le) GROUP BY ALL",
    "job_ages": "WITH n AS (SELECT max(created_at) + INTERVAL 30 SECONDS AS now FROM ingestion_jobs), m AS (SELECT id, floor(epoch(now - created_at) / 60)::BIGINT AS m FROM ingestion_jobs, n) SELECT id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM m",
    "file_sizes": "SELECT id, CASE WHEN file_size = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round(file_size / pow(1024.0, u), 2)), '0+$', ''), '\\.$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB'])[u + 1] END AS size FROM (SELECT id, file_size, CASE WHEN file_size < 1024 THEN 0 WHEN file_size < 1048576 THEN 1 WHEN file_size < 1073741824 THEN 2 ELSE 3 END AS u FROM ingestion_jobs)",
    "file_mime": "SELECT CASE lower(string_split(file_name, '.')[-1]) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.MIME.items()) + " ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM ingestion_jobs WHERE file_name IS NOT NULL GROUP BY ALL",
}
