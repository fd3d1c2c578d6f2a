"""Record queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..session import prepare, table


def _alerts(spark, sf_dir, name="alert_feed"):
    """Records of one schema name; the schemas are a small table that doesn't grow."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas").where(F.col("name") == name).select(F.col("id").alias("schema_id"))
    return table(spark, sf_dir, "data_records").join(F.broadcast(s), "schema_id", "left_semi")


def _dsl(filters, mode="text"):
    def q(spark, sf_dir):
        rows = _alerts(spark, sf_dir).withColumn("_v", R.parsed("data"))
        return rows.where(R.compile_filter(F.col("_v"), filters, mode)).select("id")

    q.__doc__ = f"Ids of the alert records that match {filters} ({mode} order)."
    return q


def dsl_order_page(spark, sf_dir):
    """Second page of alerts ordered by a JSON field as text, nulls first."""
    page, _ = R.query(_alerts(spark, sf_dir), {"status": ["active", "pending"]}, order_by="severity", limit=50, offset=50)
    return page.select("id")


def dsl_order_page_asc(spark, sf_dir):
    page, _ = R.query(_alerts(spark, sf_dir), {}, order_by="confidence", ascending=True, limit=100, offset=20)
    return page.select("id")


def record_count(spark, sf_dir):
    return R.query(_alerts(spark, sf_dir), {"severity": "low"})[1]


def record_page_newest(spark, sf_dir):
    page, _ = R.query(_alerts(spark, sf_dir), {}, limit=100)
    return page.select("id", "created_at")


def record_list_by_job(spark, sf_dir):
    """Newest records of the job with the lowest id."""
    r = table(prepare(spark), sf_dir, "data_records")
    first = r.agg(F.min("ingestion_job_id").alias("ingestion_job_id"))
    return R.listing(r.join(F.broadcast(first), "ingestion_job_id", "left_semi"), "created_at", limit=20).select("id", "created_at")


def jobs_list(spark, sf_dir):
    return R.listing(table(prepare(spark), sf_dir, "ingestion_jobs"), "created_at", limit=100, state="complete").select("id", "file_name", "state", "created_at")


def schemas_list(spark, sf_dir):
    return R.listing(table(prepare(spark), sf_dir, "basecamp_schemas"), "updated_at", status="active").select("id", "name", F.col("version").cast("bigint").alias("version"))


def schema_lookup(spark, sf_dir):
    """A schema by name, workspace and version."""
    return table(prepare(spark), sf_dir, "basecamp_schemas").where((F.col("name") == "attack_feed") & (F.col("version") == 2)).select("id", "workspace_id", "status")


def record_search(spark, sf_dir):
    return R.search(_alerts(spark, sf_dir), "HARBOUR", "id", data="data").select("id").unionByName(R.search(_alerts(spark, sf_dir), "kestrel", "id", data="data").select("id"))


def customer_search(spark, sf_dir):
    return R.search(table(prepare(spark), sf_dir, "customer"), "000001", "c_name", "c_mktsegment").select("c_custkey", "c_name")


def entity_search(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "entity_requests")
    return R.search(e, "Fleet", "value", "entity_type", arrays=("tags",)).select("request_id")


def graph_picker(spark, sf_dir):
    return R.search(table(prepare(spark), sf_dir, "entity_payloads"), "marlin", "value", "type").select("payload_id")


def record_table_view(spark, sf_dir):
    return R.table_view(_alerts(spark, sf_dir), ["severity", "status", "content_url", "alert_id", "escalated", "entity"])


def workflow_projection(spark, sf_dir):
    """Data only, as a workflow asks for it."""
    return _alerts(spark, sf_dir).where(R.compile_filter(R.parsed("data"), {"severity": "critical"})).select("data")


def field_union(spark, sf_dir):
    """Columns of an export: the union of all fields."""
    return R.field_names(_alerts(spark, sf_dir))


def active_jobs(spark, sf_dir):
    j = table(prepare(spark), sf_dir, "ingestion_jobs")
    return j.where(~F.lower("state").isin("complete", "completed", "failed")).agg(F.count("*").alias("active"))


def dashboard_counts(spark, sf_dir):
    """Rows of each table as the dashboard's cards show them."""
    prepare(spark)
    names = ("basecamp_schemas", "ingestion_jobs", "data_records", "entity_requests")
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("card"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recent_jobs(spark, sf_dir):
    return table(prepare(spark), sf_dir, "ingestion_jobs").orderBy(F.desc_nulls_last("started_at"), "id").limit(10).select("id", "started_at")


def derived_schema_status(spark, sf_dir):
    """DRAFT without fields, DEPRECATED if not updated for 30 days before the latest update of all, else ACTIVE."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    asof = s.agg(F.max("updated_at").alias("asof"))
    v = R.parsed("fields")
    size = F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))), F.lit(0))
    status = F.when(size == 0, "DRAFT").when(F.col("updated_at") < F.col("asof") - F.expr("INTERVAL 30 DAYS"), "DEPRECATED").otherwise("ACTIVE")
    return s.join(F.broadcast(asof), F.lit(True)).select("id", status.alias("derived_status"))


def records_updated(spark, sf_dir):
    """Records of failed ingests get new data, the others stay."""
    r = _alerts(spark, sf_dir).select("id", "data")
    new = r.where(R.parsed("data").isNull()).select("id", F.lit('{"status":"unreadable"}').alias("data"))
    return R.update(r, new)


def schema_cascade_delete(spark, sf_dir):
    """Records left after all deprecated schemas, their jobs and the jobs' records are deleted."""
    prepare(spark)
    gone = table(spark, sf_dir, "basecamp_schemas").where("status = 'deprecated'").select("id")
    jobs = table(spark, sf_dir, "ingestion_jobs")
    left = R.delete(jobs, gone, parent="schema_id")
    lost = jobs.select("id").join(left.select("id"), "id", "left_anti")
    return R.delete(table(spark, sf_dir, "data_records"), lost, parent="ingestion_job_id").groupBy("workspace_id").agg(F.count("*").alias("n"))


def source_patch(spark, sf_dir):
    """Jobs patched by a change list: null leaves a column as it is."""
    j = table(prepare(spark), sf_dir, "ingestion_jobs").select("id", "state", "error_message")
    c = j.where("state = 'failed'").select("id", F.lit("retried").alias("state"), F.lit(None).cast("string").alias("error_message"))
    return R.patch(j, c)


def job_schema_fallback(spark, sf_dir):
    """Schema of a job: its own, else that of the latest job of its source."""
    j = table(prepare(spark), sf_dir, "ingestion_jobs").withColumn("own", F.when(F.col("record_count") % 3 != 0, F.col("schema_id")))
    latest = j.where("source_id is not null and own is not null").groupBy("source_id").agg(F.max_by("own", F.struct("created_at", "id")).alias("of_source"))
    return j.join(latest, "source_id", "left").select("id", F.coalesce("own", "of_source").alias("schema_id"))


_DSL = {
    "dsl_eq": ({"severity": "low"}, "text"),
    "dsl_eq_bool": ({"escalated": True}, "text"),
    "dsl_in": ({"status": ["active", "parked", 0]}, "text"),
    "dsl_in_empty": ({"status": []}, "text"),
    "dsl_ne": ({"severity": {"$ne": "low"}}, "text"),
    "dsl_null": ({"severity": None}, "text"),
    "dsl_gt_text": ({"confidence": {"$gt": "0.8"}}, "text"),
    "dsl_gt_typed": ({"confidence": {"$gt": 0.8}}, "typed"),
    "dsl_range": ({"confidence": {"$gte": 0.7, "$lt": 0.9}, "severity": ["high", "critical"]}, "typed"),
    "dsl_like": ({"entity": {"$like": "MAR"}}, "text"),
    "dsl_contains": ({"severity": {"$contains": "high"}, "escalated": {"$contains": True}}, "text"),
}
QUERIES = {k: _dsl(*v) for k, v in _DSL.items()} | {
    f.__name__: f
    for f in (dsl_order_page, dsl_order_page_asc, record_count, record_page_newest, record_list_by_job, jobs_list, schemas_list, schema_lookup, record_search, customer_search, entity_search, graph_picker, record_table_view, workflow_projection, field_union, active_jobs, dashboard_counts, recent_jobs, derived_schema_status, records_updated, schema_cascade_delete, source_patch, job_schema_fallback)
}

# ---- SQL ------------------------------------------------------------------

_A = "a AS (SELECT *, CASE WHEN json_valid(data) THEN data::JSON END AS v FROM data_records WHERE schema_id IN (SELECT id FROM basecamp_schemas WHERE name = 'alert_feed'))"
_T = "(v->>'{}')"
_n = lambda f: f"try_cast(v->>'{f}' AS DOUBLE)"


def _where(cond: str) -> str:
    return f"WITH {_A} SELECT id FROM a WHERE {cond}"


_SHOW = "CASE WHEN length(coalesce(v->>'{0}', '-')) > 40 THEN left(coalesce(v->>'{0}', '-'), 40) || '...' ELSE coalesce(v->>'{0}', '-') END AS {0}"
SQL = {
    "dsl_eq": _where("v->>'severity' = 'low'"),
    "dsl_eq_bool": _where("v->>'escalated' = 'true'"),
    "dsl_in": _where("v->>'status' IN ('active', 'parked', '0')"),
    "dsl_in_empty": _where("false"),
    "dsl_ne": _where("v->>'severity' <> 'low'"),
    "dsl_null": _where("v->>'severity' IS NULL"),
    "dsl_gt_text": _where("v->>'confidence' > '0.8'"),
    "dsl_gt_typed": _where(_n("confidence") + " > 0.8"),
    "dsl_range": _where(f"{_n('confidence')} >= 0.7 AND {_n('confidence')} < 0.9 AND v->>'severity' IN ('high', 'critical')"),
    "dsl_like": _where("v->>'entity' ILIKE '%MAR%'"),
    "dsl_contains": _where("(v->'severity')::VARCHAR = '\"high\"' AND (v->'escalated')::VARCHAR = 'true'"),
    "dsl_order_page": _where("v->>'status' IN ('active', 'pending') ORDER BY v->>'severity' DESC NULLS FIRST, id LIMIT 50 OFFSET 50"),
    "dsl_order_page_asc": _where("true ORDER BY v->>'confidence' ASC NULLS LAST, id LIMIT 100 OFFSET 20"),
    "record_count": f"WITH {_A} SELECT count(*) AS total_count FROM a WHERE v->>'severity' = 'low'",
    "record_page_newest": f"WITH {_A} SELECT id, created_at FROM a ORDER BY created_at DESC NULLS FIRST, id LIMIT 100",
    "record_list_by_job": "SELECT id, created_at FROM data_records WHERE ingestion_job_id = (SELECT min(ingestion_job_id) FROM data_records) ORDER BY created_at DESC NULLS LAST, id LIMIT 20",
    "jobs_list": "SELECT id, file_name, state, created_at FROM ingestion_jobs WHERE state = 'complete' ORDER BY created_at DESC NULLS LAST, id LIMIT 100",
    "schemas_list": "SELECT id, name, version::BIGINT AS version FROM basecamp_schemas WHERE status = 'active' ORDER BY updated_at DESC NULLS LAST, id LIMIT 100",
    "schema_lookup": "SELECT id, workspace_id, status FROM basecamp_schemas WHERE name = 'attack_feed' AND version = 2",
    "record_search": f"WITH {_A}, w AS (SELECT id, list_transform(json_keys(v), k -> lower(v->>k)) AS x FROM a)".replace("k -> lower(v->>k)", "lambda k: lower(json_extract_string(v, '$.\"' || k || '\"'))") + " SELECT id FROM w WHERE contains(lower(id), 'harbour') OR len(list_filter(x, lambda t: contains(t, 'harbour'))) > 0 UNION ALL SELECT id FROM w WHERE contains(lower(id), 'kestrel') OR len(list_filter(x, lambda t: contains(t, 'kestrel'))) > 0",
    "customer_search": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '000001') OR contains(lower(c_mktsegment), '000001')",
    "entity_search": "SELECT request_id FROM entity_requests WHERE contains(lower(value), 'fleet') OR contains(lower(entity_type), 'fleet') OR len(list_filter(tags, lambda t: contains(lower(t), 'fleet'))) > 0",
    "graph_picker": "SELECT payload_id FROM entity_payloads WHERE contains(lower(value), 'marlin') OR contains(lower(type), 'marlin')",
    "record_table_view": f"WITH {_A} SELECT id, " + ", ".join(_SHOW.format(f) for f in ("severity", "status", "content_url", "alert_id", "escalated")) + " FROM a",
    "workflow_projection": f"WITH {_A} SELECT data FROM a WHERE v->>'severity' = 'critical'",
    "field_union": f"WITH {_A} SELECT field_name, count(*) AS n FROM (SELECT unnest(json_keys(v)) AS field_name FROM a WHERE json_type(v) = 'OBJECT') GROUP BY ALL",
    "active_jobs": "SELECT count(*) AS active FROM ingestion_jobs WHERE lower(state) NOT IN ('complete', 'completed', 'failed')",
    "dashboard_counts": " UNION ALL ".join(f"SELECT '{n}' AS card, count(*) AS n FROM {n}" for n in ("basecamp_schemas", "ingestion_jobs", "data_records", "entity_requests")),
    "recent_jobs": "SELECT id, started_at FROM ingestion_jobs ORDER BY started_at DESC NULLS LAST, id LIMIT 10",
    "derived_schema_status": "SELECT id, CASE WHEN (CASE json_type(fields) WHEN 'ARRAY' THEN json_array_length(fields) WHEN 'OBJECT' THEN len(json_keys(fields)) ELSE 0 END) = 0 THEN 'DRAFT' WHEN updated_at < (SELECT max(updated_at) FROM basecamp_schemas) - INTERVAL 30 DAYS THEN 'DEPRECATED' ELSE 'ACTIVE' END AS derived_status FROM basecamp_schemas",
    "records_updated": f"WITH {_A} SELECT id, CASE WHEN v IS NULL THEN '{{\"status\":\"unreadable\"}}' ELSE data END AS data FROM a",
    "schema_cascade_delete": "SELECT workspace_id, count(*) AS n FROM data_records WHERE ingestion_job_id NOT IN (SELECT id FROM ingestion_jobs WHERE schema_id IN (SELECT id FROM basecamp_schemas WHERE status = 'deprecated')) GROUP BY ALL",
    "source_patch": "SELECT id, CASE WHEN state = 'failed' THEN 'retried' ELSE state END AS state, error_message FROM ingestion_jobs",
    "job_schema_fallback": "WITH j AS (SELECT *, CASE WHEN record_count % 3 <> 0 THEN schema_id END AS own FROM ingestion_jobs), l AS (SELECT source_id, arg_max(own, (created_at, id)) AS s FROM j WHERE own IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL) SELECT j.id, coalesce(own, s) AS schema_id FROM j LEFT JOIN l USING (source_id)",
}
