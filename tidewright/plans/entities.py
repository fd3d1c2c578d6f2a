"""Entity queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entity as E
from ..operators import entities as X
from ..session import prepare, spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "url", "lang", "source", "fetched_at"))


def _found(spark, sf_dir):
    return X.extract(_docs(spark, sf_dir), "text", "doc_id")


def _first(spark, sf_dir):
    return X.deduplicate(_found(spark, sf_dir), F.struct("doc_id", "seq", "value"))


def entity_threat_summary(spark, sf_dir):
    """Flagship: entities of all documents by type and threat level."""
    e = X.enrich(_first(spark, sf_dir))
    return e.groupBy("entity_type", "threat_level").agg(F.count("*").alias("n"), F.sum("n_mentions").alias("n_mentions"))


def _extract(t):
    return lambda spark, sf_dir: X.extract_type(_docs(spark, sf_dir), "text", t, "doc_id")


def extract_page_url(spark, sf_dir):
    return X.extract_type(_docs(spark, sf_dir), "url", "url", "doc_id")


def normalize_entities(spark, sf_dir):
    return _found(spark, sf_dir).select("entity_type", "value", "normalized_value").distinct()


def normalize_strict_www(spark, sf_dir):
    v = X.extract_type(_docs(spark, sf_dir), "text", "domain", "doc_id").select("value").distinct()
    return v.select("value", E.normalize(F.lit("domain"), F.col("value"), strict_www=True).alias("normalized_value"))


def entity_dedup(spark, sf_dir):
    return _first(spark, sf_dir).select("entity_type", "normalized_value", "value", "n_mentions")


def entity_enrich(spark, sf_dir):
    e = X.enrich(_first(spark, sf_dir))
    m = F.col("metadata")
    return e.select("entity_type", "normalized_value", "threat_level", *[m[k].alias(k) for k in ("email_domain", "email_local", "domain_hash", "is_private", "url_domain", "enrichment_version")])


def _requests(spark, sf_dir):
    r = table(prepare(spark), sf_dir, "entity_requests").where("entity_id is not null and value is not null and trim(value) <> ''")
    t = F.regexp_replace(F.lower(F.trim("entity_type")), "[ -]", "_")
    return r.select("request_id", "workspace_id", t.alias("entity_type"), "value", E.normalize(t, F.col("value")).alias("normalized_value"), "confidence", "threat_level", "tags", "received_at")


def entity_tag_rescore(spark, sf_dir):
    """Tags united with a new one, threat level recomputed from value and tags."""
    e = X.tag(_requests(spark, sf_dir), F.array(F.lit("monitor")))
    return e.select("request_id", F.array_join("tags", ",").alias("tags"), "threat_level")


def entity_merge(spark, sf_dir):
    """Entities of the requests, deduplicated: first value, united tags, highest confidence."""
    e = X.deduplicate(_requests(spark, sf_dir).withColumn("last_seen", F.col("received_at")), F.col("request_id"))
    return e.select("entity_type", "normalized_value", "value", F.array_join("tags", ",").alias("tags"), "confidence", "last_seen", "n_mentions")


def _halves(spark, sf_dir):
    e = _requests(spark, sf_dir).withColumns({"source": F.concat(F.lit("request:"), F.col("request_id")), "first_seen": F.col("received_at"), "last_seen": F.col("received_at"), "metadata": F.create_map(F.lit("last"), F.col("request_id").cast("string"))})
    by = ("workspace_id", "entity_type", "normalized_value")
    half = lambda k: X.deduplicate(e.where(F.col("request_id") % 2 == k), F.col("request_id"), by).drop("n_mentions")
    return half(0), half(1)


def entity_upsert(spark, sf_dir):
    """Entities of odd requests upserted into those of even ones."""
    a, b = _halves(spark, sf_dir)
    u = X.upsert(a, b)
    return u.select("workspace_id", "entity_type", "normalized_value", "value", "source", "confidence", "threat_level", F.array_join("tags", ",").alias("tags"), "first_seen", "last_seen", F.col("metadata")["last"].alias("last"))


def entity_list_filtered(spark, sf_dir):
    e = _requests(spark, sf_dir).where((F.col("entity_type") == "domain") & (F.col("threat_level") == "high"))
    return e.orderBy(F.desc("received_at"), "request_id").offset(10).limit(100).select("request_id", "normalized_value", "received_at")


def entity_find(spark, sf_dir):
    """All requests of the entity that the lowest request names."""
    e = _requests(spark, sf_dir)
    k = e.agg(F.min_by(F.struct("workspace_id", "entity_type", "normalized_value"), "request_id").alias("k")).select("k.*")
    return e.join(F.broadcast(k), ["workspace_id", "entity_type", "normalized_value"]).select("request_id", "value")


def extract_username(spark, sf_dir):
    """User names, of which the documents have none of their own: each gets one appended."""
    d = _docs(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("Account: u_"), F.col("doc_id"))))
    return X.extract_type(d, "text", "username", "doc_id")


def record_walk(spark, sf_dir):
    """Every string of every record with the path of its key, counted by path form."""
    r = X.walk_strings(spread(table(prepare(spark), sf_dir, "data_records").select("id", "data")), "data", "id")
    return r.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("records"))


def record_entities(spark, sf_dir):
    """Entities in all strings of all records, by type: mentions and distinct normal forms."""
    r = X.extract_from_records(spread(table(prepare(spark), sf_dir, "data_records").select("id", "data")), "data", "id", label="ingestion:")
    return r.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("normalized_value").alias("entities"))


QUERIES = {
    "entity_threat_summary": entity_threat_summary,
    **{f"extract_{'ip' if t == 'ip_address' else 'handle' if t == 'social_handle' else t}": _extract(t) for t in E.PATTERNS},
    "extract_page_url": extract_page_url,
    "extract_username": extract_username,
    "normalize_entities": normalize_entities,
    "normalize_strict_www": normalize_strict_www,
    "entity_dedup": entity_dedup,
    "entity_enrich": entity_enrich,
    "entity_tag_rescore": entity_tag_rescore,
    "entity_merge": entity_merge,
    "entity_upsert": entity_upsert,
    "entity_list_filtered": entity_list_filtered,
    "entity_find": entity_find,
    "record_walk": record_walk,
    "record_entities": record_entities,
}

# ---- SQL ------------------------------------------------------------------

#: White space beyond ASCII, for patterns whose \s sees all of it.
_WS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _sql_pattern(t: str) -> str:
    return "(?i)" + E.PATTERNS[t].replace(r"[^\s", "[^" + _WS).replace(r"[-\s", "[-" + _WS).replace(r"[:\s", "[:" + _WS).replace("'", "''")


def _sql_matches(t: str, col: str = "text") -> str:
    if t == "ip_address":  # letters and digits beyond ASCII are word characters too
        col = rf"regexp_replace(regexp_replace({col}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', 'z', 'g')"
    return f"list_distinct(regexp_extract_all({col}, '{_sql_pattern(t)}', {1 if t == 'username' else 0}))"


_STRIP = f"regexp_replace(value, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_NORM = f"""CASE WHEN entity_type IN ('email', 'username') THEN lower({_STRIP})
    WHEN entity_type = 'domain' THEN ltrim(lower({_STRIP}), 'w.')
    WHEN entity_type = 'phone' THEN regexp_replace(value, '[^0-9+]', '', 'g')
    WHEN entity_type = 'social_handle' THEN ltrim(lower(value), '@')
    WHEN entity_type = 'url' THEN rtrim({_STRIP}, '/') ELSE {_STRIP} END"""
_FOUND = (
    "found AS (SELECT doc_id, seq, entity_type, value, " + _NORM + " AS normalized_value FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS seq, '{t}' AS entity_type, unnest({_sql_matches(t)}) AS value FROM documents" for i, t in enumerate(E.PATTERNS))
    + "))"
)
_FIRST = _FOUND + """, firsts AS (SELECT entity_type, normalized_value, arg_min(value, (doc_id, seq, value)) AS value, count(*) AS n_mentions FROM found GROUP BY ALL)"""


def _any(parts, col):
    return " OR ".join(f"contains({col}, '{p}')" for p in parts)


_VSCORE = "greatest(0, " + ", ".join(f"CASE WHEN entity_type = '{t}' AND ({_any(ps, 'lower(normalized_value)')}) THEN {s} ELSE 0 END" for t, d in E.VALUE_SIGNS.items() for s, ps in d.items()) + ")"
_TSCORE = "greatest(0, " + ", ".join(f"CASE WHEN len(list_filter(coalesce({{tags}}, []), lambda x: {_any(ps, 'lower(x)')})) > 0 THEN {s} ELSE 0 END" for s, ps in E.TAG_SIGNS.items()) + ")"
_LEVEL = "CASE WHEN {s} >= 4 THEN 'critical' WHEN {s} >= 3 THEN 'high' WHEN {s} >= 2 THEN 'medium' WHEN {s} >= 1 THEN 'low' ELSE 'info' END"
_PRIVATE = """(CASE WHEN len(string_split(normalized_value, '.')) = 4 THEN CASE WHEN
    try_cast(split_part(normalized_value, '.', 1) AS INT) IN (10, 127) OR (try_cast(split_part(normalized_value, '.', 1) AS INT) = 172 AND try_cast(split_part(normalized_value, '.', 2) AS INT) BETWEEN 16 AND 31)
    OR (try_cast(split_part(normalized_value, '.', 1) AS INT) = 192 AND try_cast(split_part(normalized_value, '.', 2) AS INT) = 168) THEN 'true' ELSE 'false' END END)"""
_REQ = """req AS (SELECT *, """ + _NORM + """ AS normalized_value FROM (SELECT request_id, workspace_id, replace(replace(lower(trim(entity_type)), ' ', '_'), '-', '_') AS entity_type, value, confidence, threat_level, tags, received_at
    FROM entity_requests WHERE entity_id IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''))"""

_HALF = """SELECT workspace_id, entity_type, normalized_value, arg_min(value, request_id) AS value, arg_min('request:' || request_id, request_id) AS source, arg_min_null(threat_level, request_id) AS threat_level,
    max(confidence) AS confidence, list_sort(list_distinct(flatten(list(coalesce(tags, []))))) AS tags, min(received_at) FILTER (request_id = f) AS first_seen, max(received_at) AS last_seen, max(request_id) AS last
    FROM (SELECT *, min(request_id) OVER (PARTITION BY workspace_id, entity_type, normalized_value) AS f FROM req WHERE request_id % 2 = {k}) GROUP BY ALL"""

#: Every string of every record with its path; a list within a list isn't entered.
_WALK = """parsed AS (SELECT id, CASE WHEN json_valid(data) THEN CASE WHEN json_type(data) = 'VARCHAR' AND json_valid(data->>'$') THEN (data->>'$')::JSON ELSE data::JSON END END AS v FROM data_records),
    walk AS (SELECT p.id, t.atom->>'$' AS text, replace(substr(t.fullkey, 3), '"', '') AS path FROM (SELECT * FROM parsed WHERE json_type(v) = 'OBJECT') p, json_tree(p.v) t WHERE t.type = 'VARCHAR' AND NOT contains(t.fullkey, ']['))"""

SQL = {
    "record_walk": f"WITH {_WALK} SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, count(*) AS n, count(DISTINCT id) AS records FROM walk GROUP BY ALL",
    "record_entities": f"WITH {_WALK}, found AS (SELECT entity_type, value, " + _NORM + " AS normalized_value FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS entity_type, unnest({_sql_matches(t)}) AS value FROM walk" for t in E.PATTERNS)
    + ")) SELECT entity_type, count(*) AS n, count(DISTINCT normalized_value) AS entities FROM found GROUP BY ALL",
    "entity_threat_summary": f"WITH {_FIRST} SELECT entity_type, {_LEVEL.format(s=_VSCORE)} AS threat_level, count(*) AS n, sum(n_mentions)::BIGINT AS n_mentions FROM firsts GROUP BY ALL",
    **{f"extract_{'ip' if t == 'ip_address' else 'handle' if t == 'social_handle' else t}": f"SELECT doc_id, unnest({_sql_matches(t)}) AS value FROM documents" for t in E.PATTERNS},
    "extract_page_url": f"SELECT doc_id, unnest({_sql_matches('url', 'url')}) AS value FROM documents",
    "normalize_entities": f"WITH {_FOUND} SELECT DISTINCT entity_type, value, normalized_value FROM found",
    "normalize_strict_www": f"SELECT DISTINCT value, regexp_replace(lower(trim(value)), '^www\\.', '') AS normalized_value FROM (SELECT unnest({_sql_matches('domain')}) AS value FROM documents)",
    "entity_dedup": f"WITH {_FIRST} SELECT entity_type, normalized_value, value, n_mentions FROM firsts",
    "entity_enrich": f"""WITH {_FIRST} SELECT entity_type, normalized_value, {_LEVEL.format(s=_VSCORE)} AS threat_level,
        CASE WHEN entity_type = 'email' AND len(string_split(normalized_value, '@')) = 2 THEN split_part(normalized_value, '@', 2) END AS email_domain,
        CASE WHEN entity_type = 'email' AND len(string_split(normalized_value, '@')) = 2 THEN split_part(normalized_value, '@', 1) END AS email_local,
        CASE WHEN entity_type = 'domain' THEN left(sha256(normalized_value), 16) END AS domain_hash,
        CASE WHEN entity_type = 'ip_address' THEN {_PRIVATE} END AS is_private,
        CASE WHEN entity_type = 'url' THEN nullif(regexp_extract(normalized_value, 'https?://([^/]+)', 1), '') END AS url_domain, '{E.ENRICHMENT_VERSION}' AS enrichment_version FROM firsts""",
    "entity_tag_rescore": f"""WITH {_REQ}, t AS (SELECT *, list_sort(list_distinct(list_concat(coalesce(tags, []), ['monitor']))) AS all_tags FROM req)
        SELECT request_id, array_to_string(all_tags, ',') AS tags, {_LEVEL.format(s="greatest(" + _VSCORE + ", " + _TSCORE.format(tags="all_tags") + ")")} AS threat_level FROM t""",
    "entity_merge": f"""WITH {_REQ} SELECT entity_type, normalized_value, arg_min(value, request_id) AS value, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') AS tags,
        max(confidence) AS confidence, max(received_at) AS last_seen, count(*) AS n_mentions FROM req GROUP BY ALL""",
    "entity_upsert": f"""WITH {_REQ}, a AS ({_HALF.format(k=0)}), b AS ({_HALF.format(k=1)})
        SELECT coalesce(a.workspace_id, b.workspace_id) AS workspace_id, coalesce(a.entity_type, b.entity_type) AS entity_type, coalesce(a.normalized_value, b.normalized_value) AS normalized_value,
        coalesce(a.value, b.value) AS value, coalesce(a.source, b.source) AS source, greatest(a.confidence, b.confidence) AS confidence, coalesce(b.threat_level, a.threat_level) AS threat_level,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags, coalesce(a.first_seen, b.first_seen) AS first_seen, coalesce(b.last_seen, a.last_seen) AS last_seen,
        coalesce(b.last, a.last)::VARCHAR AS last
        FROM a FULL JOIN b ON a.workspace_id IS NOT DISTINCT FROM b.workspace_id AND a.entity_type = b.entity_type AND a.normalized_value = b.normalized_value""",
    "entity_list_filtered": f"WITH {_REQ} SELECT request_id, normalized_value, received_at FROM req WHERE entity_type = 'domain' AND threat_level = 'high' ORDER BY received_at DESC, request_id LIMIT 100 OFFSET 10",
    "entity_find": f"WITH {_REQ} SELECT a.request_id, a.value FROM req a JOIN req b ON b.request_id = (SELECT min(request_id) FROM req) AND a.workspace_id = b.workspace_id AND a.entity_type = b.entity_type AND a.normalized_value = b.normalized_value",
    "extract_username": f"SELECT doc_id, unnest({_sql_matches('username', "concat_ws(' ', text, 'Account: u_' || doc_id)")}) AS value FROM documents",
}
