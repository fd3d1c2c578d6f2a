"""Source, schema, sink and stream queries, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import entity as E
from ..operators import entities as X
from ..operators import graph as G
from ..operators import pipeline as I
from ..operators import records as R
from ..operators import schema as S
from ..operators import sinks as K
from ..session import prepare, scratch, spread, table
from ..sources import connectors as N
from ..sources import files as P
from ..streaming import events as V
from . import golden
from .entities import _NORM, _WALK, _sql_matches

# ---- schemas ---------------------------------------------------------------------


def schema_profile(spark, sf_dir):
    """Types of the customer columns as text, from the first hundred rows."""
    c = table(prepare(spark), sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"), "c_name", F.col("c_nationkey").cast("string").alias("nation"), F.format_string("%.2f", "c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"))
    p = S.infer(S.cells_of_columns(c, F.col("c_custkey"), ["key", "c_name", "nation", "balance", "segment"]))
    return p.select("name", "inferred_type", "nullable", F.array_join("sample_values", ",").alias("samples"), F.round("confidence", 6).alias("confidence"))


def schema_profile_records(spark, sf_dir):
    """Types of the fields of the first hundred attack records."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas").where("name = 'attack_feed'").select(F.col("id").alias("schema_id"))
    r = table(spark, sf_dir, "data_records").join(F.broadcast(s), "schema_id", "left_semi")
    p = S.infer(S.cells_of_json(r, "data", F.col("id")), "json")
    return p.select("name", "inferred_type", "nullable", F.round("confidence", 6).alias("confidence"))


def schema_confidence(spark, sf_dir):
    c = table(prepare(spark), sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(F.col("c_nationkey").cast("string")).alias("mixed"), F.col("c_name"))
    return S.confidence(S.infer(S.cells_of_columns(c, F.col("c_custkey"), ["mixed", "c_name"]))).select(F.round("confidence", 6).alias("confidence"))


def schema_merge(spark, sf_dir):
    """All declared versions of all schemas merged per field, each with a confidence of its version."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    v = F.try_parse_json("fields")
    f = s.select(F.col("id").alias("seq"), "version", F.explode(F.try_variant_get(v, "$", "array<struct<name string, field_type string, nullable boolean>>")).alias("f"))
    p = f.select("seq", F.col("f.name").alias("name"), F.col("f.field_type").alias("inferred_type"), F.col("f.nullable").alias("nullable"), F.array("f.field_type").alias("sample_values"), (F.lit(1.0) / F.col("version")).alias("confidence"))
    return S.merge(p).select("name", "inferred_type", "nullable", F.array_join("sample_values", ",").alias("samples"), F.round("confidence", 6).alias("confidence"))


def schema_latest_version(spark, sf_dir):
    return S.latest(table(prepare(spark), sf_dir, "basecamp_schemas")).select("workspace_id", "name", F.col("version").cast("bigint").alias("version"), "id")


def schema_create(spark, sf_dir):
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    new = s.where("status = 'active'").select("workspace_id", "name", F.lit("[]").alias("fields")).unionByName(spark.createDataFrame([("w", "fresh", "[]")], "workspace_id string, name string, fields string"))
    return S.create(s, new).select("workspace_id", "name", F.col("version").cast("bigint").alias("version"), "status")


def schema_update(spark, sf_dir):
    s = table(prepare(spark), sf_dir, "basecamp_schemas")
    return S.update_fields(s, s.where("status = 'active'").select("id", F.lit("[]").alias("fields"))).groupBy("name", "status").agg(F.count("*").alias("n"), F.max("version").cast("bigint").alias("top"))


def detect_types(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "entity_requests").select(F.explode(F.array("value", F.col("confidence").cast("decimal(9,3)").cast("string"), F.date_format("received_at", "yyyy-MM-dd"), F.col("request_id").cast("string"))).alias("v"))
    return e.groupBy(S.detect_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


def validate_records(spark, sf_dir):
    """Errors of the alerts against required fields."""
    s = table(prepare(spark), sf_dir, "basecamp_schemas").where("name = 'alert_feed'").select(F.col("id").alias("schema_id"))
    r = table(spark, sf_dir, "data_records").join(F.broadcast(s), "schema_id", "left_semi").where(R.parsed("data").isNotNull())
    return r.select("id", F.explode(S.validate(F.col("data"), [("severity", False), ("alert_id", False), ("status", True)])).alias("error"))


def coerce_records(spark, sf_dir):
    """Four coercions of the size and state columns of orders, as text."""
    o = table(prepare(spark), sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(" 12 ")).when(F.col("o_orderkey") % 3 == 1, F.lit("yes")).otherwise(F.lit("x1")).alias("v"))
    return o.groupBy("v").agg(F.first(S.coerce(F.col("v"), "int")).alias("as_int"), F.first(S.coerce(F.col("v"), "bool")).alias("as_bool"), F.first(S.coerce(F.col("v"), "str")).alias("as_str"), F.count("*").alias("n"))


def transform_rules(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents").select("doc_id", "url", "n_chars", "fetched_at")
    out = S.apply_rules(d, [{"field": "url", "rule": "extract", "pattern": "https?://([^/]+)", "group": 1, "to": "host"}, {"field": "fetched_at", "rule": "format", "pattern": "yyyy-MM", "date": True, "to": "month"}, {"field": "n_chars", "rule": "cast", "type": "str"}, {"field": "n_chars", "rule": "rename", "to": "size"}])
    return out.select("doc_id", "host", "month", "size")


# ---- sinks -----------------------------------------------------------------------


def _feed(spark, sf_dir, name="takedown_feed"):
    s = table(prepare(spark), sf_dir, "basecamp_schemas").where(F.col("name") == name).select(F.col("id").alias("schema_id"))
    return table(spark, sf_dir, "data_records").join(F.broadcast(s), "schema_id", "left_semi")


def export_csv(spark, sf_dir):
    """Takedowns written as CSV with the union of their fields, and read again."""
    path = scratch(spark, "export")
    K.export(_feed(spark, sf_dir), path, "csv")
    got = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path)
    return got.groupBy("status").agg(F.count("*").alias("n"), F.count("takedown_id").alias("with_id"))


def export_parquet(spark, sf_dir):
    path = scratch(spark, "export")
    K.export(_feed(spark, sf_dir), path, "parquet")
    return spark.read.parquet(path).groupBy("domain").agg(F.count("*").alias("n"))


def load_lake(spark, sf_dir):
    """Records loaded into a lake partitioned by workspace, read with a pruned scan."""
    path = scratch(spark, "lake")
    K.load_records(table(prepare(spark), sf_dir, "data_records").select("id", "workspace_id", "data"), path, "workspace_id")
    return spark.read.parquet(path).groupBy("workspace_id").agg(F.count("*").alias("n"))


def job_ledger(spark, sf_dir):
    j = table(prepare(spark), sf_dir, "ingestion_jobs")
    t = j.select(F.col("id").alias("job_id"), F.lit("received").alias("state"), F.col("created_at").alias("at"), F.lit(0).alias("records")).unionByName(j.where("completed_at is not null").select(F.col("id").alias("job_id"), F.col("state"), F.col("completed_at").alias("at"), F.coalesce("processed_records", F.lit(0)).alias("records")))
    return K.job_ledger(t).select("job_id", "state", F.col("records").cast("bigint").alias("records"))


# ---- files and connectors, over captured fixtures -----------------------------------


def _write(spark, files: dict[str, bytes]) -> str:
    """Put small fixture files into the shared folder through Spark's file system."""
    base = scratch(spark, "files")
    jvm = spark.sparkContext._jvm
    for name, content in files.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        s.write(bytearray(content))
        s.close()
    return base


#: Small uploads of every format, good and broken.
UPLOADS = {
    "a.csv": b"a;b\n1;2\n3;4\n",
    "b.csv": b"x,y\n1\n1,2,3\nyes,\n",
    "dup.csv": b"a,a\n1,2\n",
    "latin.csv": "name,n\ncaf\xe9,1\n".encode("latin-1"),
    "a.json": b'[{"a":1},{"a":"x"},5]',
    "one.json": b'{"k":{"z":1}}',
    "root.json": b"5",
    "a.jsonl": b'{"a":1}\n\n{"a":\n{"a":2}\n',
    "a.txt": b"text",
}


def parse_uploads(spark, sf_dir):
    """Parsed rows and errors of small uploads, one of a workbook."""
    prepare(spark)
    files = UPLOADS | {"a.xlsx": P.write_xlsx(["a", "b c"], [["1", None], ["", ""], ["x", "y"]])}
    return P.parse_files(spark, _write(spark, files)).select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "row_number", "source_sheet", "data", "severity")


def upload_jobs(spark, sf_dir):
    """State of the job of each small upload."""
    jobs = P.split_parsed(P.parse_files(prepare(spark), _write(spark, UPLOADS)))[2]
    return jobs.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "state", "total_records", "processed_records", "n_errors", "n_warnings")


ANSWERS = {
    "info.json": {"plan": "dev", "query_credits": 3, "scan_credits": 0},
    "host.json": {"ip_str": "192.0.2.7", "hostnames": ["a.example"], "country_code": "XA", "ports": [22], "data": [{"port": 22, "transport": "tcp", "product": "sshd", "data": "x" * 600}]},
    "domain.json": {"domain": "a.example", "subdomains": ["www"], "data": {"A": ["192.0.2.7"], "MX": []}},
    "search.json": [{"ip_str": "192.0.2.8", "port": 80, "transport": "tcp", "location": {"country_code": "XB"}, "data": "hello"}],
    "alerts.json": [{"id": 1, "status": "Open", "entity": {"name": "Brand"}, "perpetrator": {"username": "u"}}, {"id": 2, "status": "closed"}],
    "entities.json": [{"id": 9, "name": "Brand", "labels": ["vip"], "type_id": 4}],
    "attacks.json": [{"id": "a1", "url": "https://x.invalid/1", "type": "phishing", "country_code": "XA", "domain": "x.invalid"}],
    "takedowns.json": [{"id": "t1", "attack_url": "https://x.invalid/1", "submitted": "2025-01-01", "hoster": "H"}],
}


def connector_union(spark, sf_dir):
    """Answers of three feeds in one frame; a fourth fails and is left out."""
    prepare(spark)
    base = _write(spark, {k: json.dumps(v).encode() for k, v in ANSWERS.items()})
    feeds = [N.ScanConnector("scan", base), N.AlertConnector("alerts", base), N.TakedownConnector("takedowns", base), N.Connector("broken", base)]
    return N.fetch_all(spark, feeds)[0].select("entity_type", "source", "status", "attack_url", "entity", "plan")


def connector_hosts(spark, sf_dir):
    base = _write(prepare(spark), {k: json.dumps(v).encode() for k, v in ANSWERS.items()})
    h = N.ScanConnector("scan", base).fetch(spark, "192.0.2.7").data
    return h.select("ip", "country", F.explode("services").alias("s")).select("ip", "country", "s.port", F.length("s.banner").cast("bigint").alias("banner_length"))


RECON = ["[*] start", "Emails found:", "----", "a@x.example", "nothing", "Hosts found:", "www.x.example:192.0.2.1", "mail.x.example", "IPs found:", "192.0.2.9", "[*] done", "after"]


def connector_recon(spark, sf_dir):
    lines = prepare(spark).createDataFrame([("f", i, t) for i, t in enumerate(RECON)], "file string, line_no int, value string")
    text = N.recon_sections(lines, "x.example")
    xml = spark.createDataFrame([("<r><email>b@x.example</email><host ip='192.0.2.2'>ftp.x.example</host><ip>192.0.2.3</ip></r>",)], "x string")
    return text.unionByName(N.recon_xml(xml, "x.example", "x"))


def connector_accounts(spark, sf_dir):
    prepare(spark)
    j = spark.createDataFrame([('{"SiteA": {"status": "Claimed", "url_user": "https://a.example/u", "http_status": 200}, "SiteB": {"status": "Available"}}',)], "j string")
    lines = spark.createDataFrame([("SiteC: https://c.example/u",), ("done",)], "value string")
    return N.claimed_accounts(j, "u", "j").select("platform", "url", "status").unionByName(N.printed_accounts(lines, "u").select("platform", "url", "status"))


def pipeline_records(spark, sf_dir):
    """A two-line upload to entities: parse, extract, deduplicate, enrich; all records go through ``pipeline_ingest``."""
    prepare(spark)
    up = {"m.jsonl": b'{"note":"Mail Bob@ProtonMail.com from 10.0.0.12"}\n{"note":"see https://www.web.com/a/ @Amy","deep":{"l":["bob@protonmail.com"]}}\n'}
    records, _, _ = P.split_parsed(P.parse_files(spark, _write(spark, up)))
    e = X.extract_from_records(records, "data", "file", "row_number")
    d = X.enrich(X.deduplicate(e, F.struct("row_number", "source", "seq", "value")))
    return d.select("entity_type", "normalized_value", "threat_level", "n_mentions")


def _part(df, part, kind):
    """(part, kind, n, digest): rows of a frame by kind, and a digest that reads every column of every row."""
    flat = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    return df.groupBy(kind.cast("string").alias("kind")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*flat)).alias("digest")).select(F.lit(part).alias("part"), "kind", "n", "digest")


def pipeline_ingest(spark, sf_dir):
    """The whole pipeline over all records: (part, kind, n, digest) of its entities, nodes, edges, vectors, review and events."""
    got = I.ingest(spread(table(prepare(spark), sf_dir, "data_records").select("id", "workspace_id", "data", "created_at")))
    parts = [(got.entities, "entities", "entity_type"), (got.nodes, "nodes", "label"), (got.edges, "edges", "type"), (got.vectors, "vectors", "entity_type"), (got.review, "review", "item_type"), (got.events, "events", "subject")]
    out = [_part(df, name, F.col(kind)) for df, name, kind in parts]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


def pipeline_counts(spark, sf_dir):
    """What :func:`pipeline_ingest` gives, without the digests."""
    return pipeline_ingest(spark, sf_dir).select("part", "kind", "n")


# ---- streams ---------------------------------------------------------------------


def _published(spark, sf_dir, whole=False):
    """The messages of the table as a stream's folder of a few files: those with an id or, ``whole``, all.

    A message without id has no copies; of ``whole`` it gets an id of its own from its delivery.
    """
    m, own = table(prepare(spark), sf_dir, "event_messages"), F.lower(F.trim("event_id"))
    m = m.withColumn("event_id", F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("delivery-"), F.col("delivery_id").cast("string"))) if whole else own).where("event_id <> ''")
    path = scratch(spark, "events")
    V.publish(m.select("event_id", "event_type", V.subject(F.col("event_type")).alias("subject"), "timestamp", "source", "correlation_id", "metadata", "payload"), path)
    return path


def stream_event_dedup(spark, sf_dir):
    """Messages with an id read as a stream, each id once."""
    out, path = scratch(spark, "out"), _published(spark, sf_dir)
    V.once_stored(V.subscribe(spark, path).select("event_id", "event_type"), out, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("event_id string, event_type string").parquet(out).select("event_id", "event_type")


def _subject_counts(spark, path):
    out = scratch(spark, "out")
    s = V.subscribe(spark, path, "events.entity.*").withColumn("timestamp", F.col("timestamp").cast("timestamp"))

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    w = s.groupBy(F.window("timestamp", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    w.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_subject_counts(spark, sf_dir):
    """Messages with an id of one family, counted per day in a stream that is flushed by a last event."""
    return _subject_counts(spark, _published(spark, sf_dir))


def stream_subject_counts_whole(spark, sf_dir):
    """All messages of one family, with an id or not, counted per day in a stream."""
    return _subject_counts(spark, _published(spark, sf_dir, whole=True))


def _ingested(spark, path):
    out = scratch(spark, "out")

    def handle(batch, _):
        batch.where(R.parsed("payload").isNotNull()).select("event_id", "event_type").write.mode("append").parquet(out)

    V.poll(V.subscribe(spark, path), handle, scratch(spark, "checkpoint"), once_only=True).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_ingest(spark, sf_dir):
    """A polled feed of the messages with an id: each batch is parsed and appended once, counted at the end."""
    return _ingested(spark, _published(spark, sf_dir))


def stream_ingest_whole(spark, sf_dir):
    """A polled feed of all messages, with an id or not: each batch is parsed and appended once, counted at the end."""
    return _ingested(spark, _published(spark, sf_dir, whole=True))


def event_retention(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "event_messages").withColumn("event_id", F.col("delivery_id"))
    now = e.agg(F.max("timestamp").alias("now"))
    kept = e.join(F.broadcast(now), F.lit(True))
    return V.retained(kept, F.col("now")).agg(F.count("*").alias("n"), F.min("delivery_id").alias("first"))


def event_build(spark, sf_dir):
    """Typed events for completed ingests, by subject."""
    j = table(prepare(spark), sf_dir, "ingestion_jobs").where("state = 'complete'")
    e = j.select(*V.event("ingestion.complete", F.sha2("id", 256), F.coalesce("completed_at", "created_at"), F.lit("engine"), file_id=F.col("id"), file_name=F.col("file_name"), record_count=F.col("record_count")))
    return e.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(V.subject_matches(F.col("subject"), "events.ingestion.*")).alias("matching"))


QUERIES = {
    f.__name__: f
    for f in (schema_profile, schema_profile_records, schema_confidence, schema_merge, schema_latest_version, schema_create, schema_update, detect_types, validate_records, coerce_records, transform_rules,
              export_csv, export_parquet, load_lake, job_ledger, parse_uploads, upload_jobs, connector_union, connector_hosts, connector_recon, connector_accounts, pipeline_records, pipeline_ingest, pipeline_counts,
              stream_event_dedup, stream_subject_counts, stream_subject_counts_whole, stream_ingest, stream_ingest_whole, event_retention, event_build)
}

# ---- SQL ------------------------------------------------------------------

_TYPE = r"""CASE WHEN v IS NULL THEN NULL WHEN lower(t) IN ('true', 'false', 'yes', 'no', '1', '0') THEN 'bool' WHEN regexp_full_match(t, '[+-]?\d+(_\d+)*') THEN 'int'
    WHEN regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') OR regexp_full_match(lower(t), '[+-]?(inf|infinity|nan)') THEN 'float'
    WHEN regexp_full_match(t, '\d{4}-\d{2}-\d{2}') OR regexp_matches(t, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}') OR regexp_full_match(t, '\d{2}[/]\d{2}[/]\d{4}') OR regexp_full_match(t, '\d{2}-\d{2}-\d{4}') THEN 'datetime' ELSE 'str' END"""
_RANK = "CASE ty WHEN 'int' THEN 0 WHEN 'float' THEN 1 WHEN 'bool' THEN 2 WHEN 'datetime' THEN 3 ELSE 4 END"
_INFER = f""", x AS (SELECT *, trim(v) AS t FROM cells), ty AS (SELECT ord, name, v, {_TYPE} AS ty FROM x), vote AS (SELECT name, ty, count(*) AS n FROM ty WHERE ty IS NOT NULL GROUP BY ALL),
    best AS (SELECT name, arg_min(ty, (-n, {_RANK})) AS ty, max(n) / sum(n) AS c FROM vote GROUP BY ALL),
    prof AS (SELECT x.name, coalesce(any_value(b.ty), 'str') AS inferred_type, bool_or(v IS NULL OR v = '') AS nullable, coalesce(string_agg(v, ',' ORDER BY ord) FILTER (ord <= 5 AND v <> ''), '') AS samples, round(coalesce(any_value(b.c), 0.5), 6) AS confidence FROM x LEFT JOIN best b ON x.name = b.name GROUP BY x.name)"""
_CUST = "c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS ord FROM customer QUALIFY ord <= 100)"
_AL = "a AS (SELECT *, CASE WHEN json_valid(data) THEN data::JSON END AS v FROM data_records WHERE schema_id IN (SELECT id FROM basecamp_schemas WHERE name = '{}'))"
_WHOLE = "m AS (SELECT coalesce(nullif(lower(trim(event_id)), ''), 'delivery-' || delivery_id) AS event_id, event_type, timestamp, payload FROM event_messages)"
_MSG = "m AS (SELECT lower(trim(event_id)) AS event_id, event_type, timestamp, payload FROM event_messages WHERE event_id IS NOT NULL AND trim(event_id) <> '')"
SQL = {
    **{k: golden.SQL[k] for k in ("parse_uploads", "upload_jobs", "connector_union", "connector_hosts", "connector_recon", "connector_accounts", "pipeline_records")},
    "stream_subject_counts_whole": f"WITH {_WHOLE} SELECT date_trunc('day', timestamp)::TIMESTAMP AS start, event_type, count(*) AS n FROM m WHERE event_type LIKE 'entity.%' GROUP BY ALL",
    "stream_ingest_whole": f"WITH {_WHOLE} SELECT event_type, count(*) AS n FROM m WHERE json_valid(payload) GROUP BY ALL",
    "schema_profile_records": "WITH " + _AL.format("attack_feed") + f""", o AS (SELECT row_number() OVER (ORDER BY id) AS ord, v FROM a WHERE json_type(v) = 'OBJECT' QUALIFY ord <= 100), k AS (SELECT DISTINCT unnest(json_keys(v)) AS name FROM o),
        c AS (SELECT ord, name, json_extract(v, '$."' || name || '"') AS j FROM o, k), x AS (SELECT *, json_type(j) AS jt, j->>'$' AS v, trim(j->>'$') AS t FROM c), ty AS (SELECT name, v, CASE WHEN jt IS NULL OR jt = 'NULL' THEN NULL WHEN jt = 'BOOLEAN' THEN 'bool' WHEN jt IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN jt = 'DOUBLE' THEN 'float' WHEN jt = 'VARCHAR' THEN {_TYPE} ELSE 'str' END AS ty FROM x),
        vote AS (SELECT name, ty, count(*) AS n FROM ty WHERE ty IS NOT NULL GROUP BY ALL), best AS (SELECT name, arg_min(ty, (-n, {_RANK})) AS ty, max(n) / sum(n) AS c FROM vote GROUP BY ALL)
        SELECT ty.name, coalesce(any_value(b.ty), 'str') AS inferred_type, bool_or(v IS NULL OR v = '') AS nullable, round(coalesce(any_value(b.c), 0.5), 6) AS confidence FROM ty LEFT JOIN best b ON ty.name = b.name GROUP BY ty.name""",
    "pipeline_counts": f"""WITH {_WALK}, w AS (SELECT walk.id, walk.text, walk.path, r.workspace_id, r.created_at FROM walk JOIN data_records r ON walk.id = r.id),
        found AS (SELECT id, workspace_id, created_at, entity_type, value, {_NORM} AS normalized_value FROM ({" UNION ALL ".join(f"SELECT id, workspace_id, created_at, '{t}' AS entity_type, unnest({_sql_matches(t)}) AS value FROM w" for t in E.PATTERNS)})),
        e AS (SELECT workspace_id, entity_type, normalized_value, first(id ORDER BY created_at NULLS FIRST, id) AS id FROM found GROUP BY ALL), k AS (SELECT id, count(*) AS n FROM e GROUP BY ALL),
        l AS (SELECT *, CASE translate(upper(entity_type), ' -', '__') {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in G.TYPE_LABELS.items())} ELSE 'Entity' END AS label FROM e)
        SELECT 'entities' AS part, entity_type AS kind, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'vectors', entity_type, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'nodes', label, count(*) FROM l GROUP BY ALL
        UNION ALL SELECT 'edges', CASE WHEN n < {G.MANY} THEN 'ASSOCIATED_WITH' ELSE 'EXTRACTED_FROM' END, sum(CASE WHEN n < {G.MANY} THEN n * (n - 1) // 2 ELSE n END)::BIGINT FROM k GROUP BY ALL UNION ALL SELECT 'events', 'events.ingestion.complete', 1""",
    "schema_profile": f"""WITH {_CUST}, cells AS (SELECT ord, unnest(['key', 'c_name', 'nation', 'balance', 'segment']) AS name, unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, printf('%.2f', c_acctbal), CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END]) AS v FROM c){_INFER} SELECT * FROM prof""",
    "schema_confidence": f"""WITH {_CUST}, cells AS (SELECT ord, unnest(['mixed', 'c_name']) AS name, unnest([CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE c_nationkey::VARCHAR END, c_name]) AS v FROM c){_INFER} SELECT round(avg(confidence), 6) AS confidence FROM prof""",
    "schema_merge": """WITH f AS (SELECT id AS seq, version, unnest(json_transform(fields, '[{"name":"VARCHAR","field_type":"VARCHAR","nullable":"BOOLEAN"}]')) AS f FROM basecamp_schemas WHERE json_type(fields) = 'ARRAY'), p AS (SELECT seq, f.name, f.field_type AS ty, f.nullable, 1.0::DOUBLE / version AS c FROM f),
        w AS (SELECT name, ty, sum(c) AS w, min(seq) AS first FROM p GROUP BY ALL), b AS (SELECT name, first(ty ORDER BY round(w, 9) DESC, first ASC) AS ty FROM w GROUP BY ALL),
        s AS (SELECT name, ty, min(seq) AS q FROM p GROUP BY ALL), ss AS (SELECT name, string_agg(ty, ',' ORDER BY q) AS samples FROM s GROUP BY ALL)
        SELECT p.name, any_value(b.ty) AS inferred_type, bool_or(nullable) AS nullable, any_value(samples) AS samples, round(avg(c), 6) AS confidence FROM p JOIN b ON p.name = b.name JOIN ss ON p.name = ss.name GROUP BY p.name""",
    "schema_latest_version": "SELECT workspace_id, name, version::BIGINT AS version, id FROM basecamp_schemas QUALIFY row_number() OVER (PARTITION BY workspace_id, name ORDER BY version DESC, id DESC) = 1",
    "schema_create": "SELECT n.workspace_id, n.name, (coalesce(t.top, 0) + 1)::BIGINT AS version, 'draft' AS status FROM (SELECT workspace_id, name FROM basecamp_schemas WHERE status = 'active' UNION ALL SELECT 'w', 'fresh') n LEFT JOIN (SELECT workspace_id, name, max(version) AS top FROM basecamp_schemas GROUP BY ALL) t ON n.workspace_id = t.workspace_id AND n.name = t.name",
    "schema_update": "WITH t AS (SELECT *, max(version) OVER (PARTITION BY workspace_id, name) AS top FROM basecamp_schemas), u AS (SELECT name, CASE WHEN status = 'active' THEN 'deprecated' ELSE status END AS status, version FROM t UNION ALL SELECT name, 'active', top + 1 FROM t WHERE status = 'active') SELECT name, status, count(*) AS n, max(version)::BIGINT AS top FROM u GROUP BY ALL",
    "detect_types": f"WITH x AS (SELECT v, trim(v) AS t FROM (SELECT unnest([value, confidence::DECIMAL(9,3)::VARCHAR, strftime(received_at, '%Y-%m-%d'), request_id::VARCHAR]) AS v FROM entity_requests)) SELECT {_TYPE} AS type, count(*) AS n FROM x GROUP BY ALL",
    "validate_records": "WITH " + _AL.format("alert_feed") + ", e AS (SELECT id, CASE WHEN json_type(v) IS DISTINCT FROM 'OBJECT' OR NOT json_exists(v, '$.' || f) THEN 'Missing required field: ' || f WHEN json_extract_string(v, f) IS NULL THEN 'Field ''' || f || ''' cannot be null' END AS error FROM a, (SELECT unnest(['severity', 'alert_id']) AS f) WHERE v IS NOT NULL) SELECT * FROM e WHERE error IS NOT NULL",
    "coerce_records": "SELECT v, CASE v WHEN ' 12 ' THEN '12' ELSE v END AS as_int, (v = 'yes')::VARCHAR AS as_bool, v AS as_str, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'yes' ELSE 'x1' END AS v FROM orders) GROUP BY ALL",
    "transform_rules": "SELECT doc_id, nullif(regexp_extract(url, 'https?://([^/]+)', 1), '') AS host, strftime(fetched_at, '%Y-%m') AS month, n_chars::VARCHAR AS size FROM documents",
    "export_csv": "WITH " + _AL.format("takedown_feed") + " SELECT nullif(v->>'status', '') AS status, count(*) AS n, count(nullif(v->>'takedown_id', '')) AS with_id FROM a GROUP BY ALL",
    "export_parquet": "WITH " + _AL.format("takedown_feed") + " SELECT coalesce(v->>'domain', '') AS domain, count(*) AS n FROM a GROUP BY ALL",
    "load_lake": "SELECT workspace_id, count(*) AS n FROM data_records GROUP BY ALL",
    "job_ledger": "SELECT id AS job_id, CASE WHEN completed_at IS NOT NULL AND completed_at >= created_at THEN state ELSE 'received' END AS state, CASE WHEN completed_at IS NOT NULL THEN coalesce(processed_records, 0) ELSE 0 END::BIGINT AS records FROM ingestion_jobs",
    "stream_event_dedup": f"WITH {_MSG} SELECT event_id, any_value(event_type) AS event_type FROM m GROUP BY event_id",
    "stream_subject_counts": f"WITH {_MSG} SELECT date_trunc('day', timestamp)::TIMESTAMP AS start, event_type, count(*) AS n FROM m WHERE event_type LIKE 'entity.%' GROUP BY ALL",
    "stream_ingest": f"WITH {_MSG} SELECT event_type, count(*) AS n FROM m WHERE json_valid(payload) GROUP BY ALL",
    "event_retention": "SELECT count(*) AS n, min(delivery_id) AS first FROM (SELECT delivery_id FROM event_messages WHERE timestamp >= (SELECT max(timestamp) FROM event_messages) - INTERVAL 7 DAYS ORDER BY timestamp DESC, delivery_id LIMIT 100000)",
    "event_build": "SELECT 'events.ingestion.complete' AS subject, count(*) AS n, count(*) AS matching FROM ingestion_jobs WHERE state = 'complete'",
}
