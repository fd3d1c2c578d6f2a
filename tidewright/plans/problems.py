"""Queries of the general problems (2 to 6) over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, drift, messages, nested, profile
from ..session import prepare, spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present state of every entity: (entity_id, field_name, field_value)."""
    return changes.current_state(table(prepare(spark), sf_dir, "entity_changes"))


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of :func:`p2_found`, the feed coming in three loads that overlap: later ones are merged into the touched buckets."""
    return changes.current_state(table(prepare(spark), sf_dir, "entity_changes"), loads=3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened child objects: (record_id, parent_path, child_path, lat)."""
    return nested.occurrences(spread(table(prepare(spark), sf_dir, "data_records").select("id", "data"))).select("record_id", "parent_path", "child_path", "lat")


def p3_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct object of the records once: (object_id, body, n)."""
    return nested.objects(table(prepare(spark), sf_dir, "data_records"))


def p3_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-child bridge rows of every object, with ordinals and object identities."""
    return nested.occurrences(table(prepare(spark), sf_dir, "data_records"), keys=None, promote=())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later deliveries of each event: (kept_id, copy_id)."""
    return messages.message_copies(table(prepare(spark), sf_dir, "event_messages"))


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "data_records").select("id", F.col("ingestion_job_id").alias("job"), "schema_id", "data"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of layout between versions, and between schemas and loads: (scope_id, change_kind, field_name, new_name)."""
    prepare(spark)
    schemas = table(spark, sf_dir, "basecamp_schemas")
    return drift.version_changes(schemas).unionByName(drift.load_changes(_loads(spark, sf_dir), schemas))


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table under one name per field: (record_id, job_id, scope, field_name, field_value)."""
    prepare(spark)
    rows = drift.unified(_loads(spark, sf_dir), table(spark, sf_dir, "basecamp_schemas"))
    return rows.select("record_id", "job_id", "scope", F.explode("fields").alias("field_name", "field_value"))


#: Schema names whose records are flat. (fixed values of the task's statement)
FLAT = ("attack_feed", "takedown_feed", "alert_feed", "social_accounts", "harvest_hosts", "malware_samples")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that break the form of their field, and loads that stand apart: (job_id, record_id, field_name)."""
    prepare(spark)
    # One row per schema version, a table that doesn't grow.
    flat = table(spark, sf_dir, "basecamp_schemas").where(F.col("name").isin(*FLAT)).select(F.col("id").alias("schema_id"), F.col("name").alias("scope"))
    ids = [r[0] for r in flat.select("schema_id").distinct().collect()]
    records = table(spark, sf_dir, "data_records").where(F.col("schema_id").isin(ids) & F.col("data").isNotNull())
    records = spread(records.select("id", F.col("ingestion_job_id").alias("job"), "data", "schema_id")).join(F.broadcast(flat), "schema_id").select("scope", "job", "id", "data")
    names = table(spark, sf_dir, "ingestion_jobs").where(F.col("schema_id").isin(ids)).select("id", "file_name", "schema_id").join(F.broadcast(flat), "schema_id")
    names = profile.malformed_names(names).select("job_id", F.lit("").alias("record_id"), F.lit("file_name").alias("field_name"))
    return profile.find_violations(records).unionByName(names)


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profile of two tables from their footers: (table_name, column_name, column_type, n_rows, n_nulls, distinct_values, min_value, max_value)."""
    prepare(spark)
    return profile.column_profile(table(spark, sf_dir, "ingestion_jobs"), "ingestion_jobs").unionByName(profile.column_profile(table(spark, sf_dir, "data_records"), "data_records"))


QUERIES = {"p4_found": p4_found, "p4_unified": p4_unified, "p5_found": p5_found, "p5_profile": p5_profile, "p2_found": p2_found, "p2_merged": p2_merged, "p3_found": p3_found, "p3_objects": p3_objects, "p3_bridge": p3_bridge, "p6_found": p6_found}

_P2_VALUE = "CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.old') AND json_exists(j, '$.new') THEN j->>'$.new' ELSE j->>'$' END"
SQL = {
    "p2_found": f"""
        WITH ev AS (SELECT min(feed_seq) AS seq, arg_min(entity_id, feed_seq) AS entity_id, arg_min(split_part(event_type, '.', 2), feed_seq) AS kind, arg_min(timestamp, feed_seq) AS ts, arg_min_null(entity_data, feed_seq) AS made, arg_min_null(changes, feed_seq) AS changes
            FROM entity_changes WHERE entity_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY coalesce(nullif(lower(trim(event_id)), ''), '#' || feed_seq)),
        b AS (SELECT entity_id, arg_max(kind, (ts, seq)) AS kind, arg_max_null(made, (ts, seq)) AS data, max((ts, seq)) AS o FROM ev WHERE kind IN ('created', 'deleted') GROUP BY entity_id),
        m AS (SELECT entity_id, k, json_extract(data, '$."' || k || '"')->>'$' AS v FROM (SELECT entity_id, data, unnest(json_keys(data)) AS k FROM b WHERE kind = 'created' AND json_valid(data))),
        u AS (SELECT entity_id, k, {_P2_VALUE} AS v, ts, seq FROM (SELECT entity_id, ts, seq, k, json_extract(changes, '$."' || k || '"') AS j FROM (SELECT *, unnest(json_keys(changes)) AS k FROM ev WHERE kind = 'updated' AND json_valid(changes)))),
        l AS (SELECT u.entity_id, k, arg_max_null(v, (ts, seq)) AS v FROM u JOIN b ON u.entity_id = b.entity_id AND b.kind = 'created' AND (ts, seq) > b.o GROUP BY ALL)
        SELECT entity_id, k AS field_name, v AS field_value FROM (SELECT coalesce(m.entity_id, l.entity_id) AS entity_id, coalesce(m.k, l.k) AS k, CASE WHEN l.k IS NOT NULL THEN l.v ELSE m.v END AS v FROM m FULL JOIN l ON m.entity_id = l.entity_id AND m.k = l.k) WHERE v IS NOT NULL""",
    "p6_found": r"""
        WITH a AS (SELECT delivery_id AS d, trim(event_id) AS t, regexp_replace(regexp_replace(lower(event_id), '^[^0-9a-z]*(urn[^0-9a-z]*)?(uuid[^0-9a-z]*)?', ''), '[^\p{L}\p{N}]', '', 'g') AS h FROM event_messages),
        b AS (SELECT d, CASE WHEN regexp_full_match(h, '[0-9a-f]{32}') THEN h WHEN t <> '' THEN '=' || t END AS k FROM a),
        c AS (SELECT d, min(d) OVER (PARTITION BY k) AS m FROM b WHERE k IS NOT NULL)
        SELECT m AS kept_id, d AS copy_id FROM c WHERE d <> m""",
}
SQL["p2_merged"] = SQL["p2_found"]

_KEYS = "', '".join(nested.CHILD_KEYS)
SQL["p3_found"] = f"""
    WITH r AS (SELECT id, CASE WHEN json_valid(data) THEN CASE WHEN json_type(data) = 'VARCHAR' AND json_valid(data->>'$') THEN (data->>'$')::JSON ELSE data::JSON END END AS v FROM data_records),
    o AS (SELECT r.id, replace(substr(t.fullkey, CASE WHEN t.fullkey[2] = '.' THEN 3 ELSE 2 END), '"', '') AS path, t.value AS o FROM (SELECT * FROM r WHERE json_type(v) IN ('OBJECT', 'ARRAY')) r, json_tree(r.v) t WHERE t.type = 'OBJECT' AND t.fullkey <> '$'),
    c AS (SELECT id, path, coalesce(json_extract_string(o, 'lat'), '') AS lat FROM o WHERE regexp_extract(path, '([^.\\[\\]]+)(\\[[0-9]+\\])*$', 1) IN ('{_KEYS}')),
    p AS (SELECT c.id, c.path, max(u.path) AS parent FROM c JOIN c u ON c.id = u.id AND starts_with(c.path, u.path || '.') GROUP BY ALL)
    SELECT c.id AS record_id, coalesce(p.parent, '') AS parent_path, c.path AS child_path, c.lat FROM c LEFT JOIN p ON c.id = p.id AND c.path = p.path"""
#: Columns of the profiled tables. (fixed values of the tables)
_COLUMNS = {
    "ingestion_jobs": {"string": "id workspace_id data_source_id source_id schema_id state file_name file_format error_message job_metadata", "bigint": "file_size", "int": "record_count total_records processed_records failed_records", "timestamp_ntz": "started_at created_at completed_at"},
    "data_records": {"string": "id workspace_id schema_id ingestion_job_id job_id data", "timestamp_ntz": "created_at updated_at"},
}
SQL["p5_profile"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS column_type, count(*) AS n_rows, (count(*) - count({c})) AS n_nulls, count(DISTINCT {c}) AS distinct_values, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM {t}"
    for t, kinds in _COLUMNS.items()
    for k, names in kinds.items()
    for c in names.split()
)
