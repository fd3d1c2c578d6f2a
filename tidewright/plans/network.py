"""Graph and vector queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as X
from ..operators import graph as G
from ..operators import vectors as V
from ..session import prepare, spread, table
from .entities import _FIRST, _FOUND


def _nodes(spark, sf_dir):
    prepare(spark)
    t = lambda n, k, v, lab: table(spark, sf_dir, n).select(F.concat(F.lit(k[0]), F.col(k)).alias("id"), F.lit(lab).alias("label"), F.col(v).alias("value"), F.lower(v).alias("normalized_value"), F.lit("ws" + k[0]).alias("workspace_id"))
    return t("region", "r_regionkey", "r_name", "Country").unionByName(t("nation", "n_nationkey", "n_name", "Country")).unionByName(t("supplier", "s_suppkey", "s_name", "Organization")).unionByName(t("customer", "c_custkey", "c_name", "Person"))


def _edges(spark, sf_dir):
    prepare(spark)
    e = lambda n, a, b, kind: table(spark, sf_dir, n).select(F.concat(F.lit(a[0]), F.col(a)).alias("src"), F.concat(F.lit("n" if b != "n_regionkey" else "r"), F.col(b)).alias("dst"), F.lit(kind).alias("type"))
    return e("nation", "n_nationkey", "n_regionkey", "PART_OF").unionByName(e("supplier", "s_suppkey", "s_nationkey", "LOCATED_IN")).unionByName(e("customer", "c_custkey", "c_nationkey", "RESIDES_AT"))


def graph_label_map(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "entity_requests")
    return e.groupBy(F.trim("entity_type").alias("entity_type"), G.label(F.trim("entity_type")).alias("label")).agg(F.count("*").alias("n"))


def graph_export_nodes(spark, sf_dir):
    """Entities of the requests as nodes with flattened metadata, one per entity id."""
    r = table(prepare(spark), sf_dir, "entity_requests").where("entity_id is not null")
    first = r.groupBy("entity_id").agg(F.min_by(F.struct("entity_type", "value", "workspace_id"), "request_id").alias("w")).select("entity_id", "w.*")
    n = G.nodes(first.withColumn("metadata", F.create_map(F.lit("kind"), F.col("entity_type"), F.lit("none"), F.lit(None).cast("string"))), F.col("entity_id"))
    return n.select("id", "label", "value", "workspace_id", F.col("properties")["meta_kind"].alias("meta_kind"), F.size("properties").cast("bigint").alias("n_properties"))


def _all_entities(spark, sf_dir):
    """(id, source_record_id, entity_type, value): entities of every type, each with its first document."""
    e = X.extract(spread(table(prepare(spark), sf_dir, "documents").select("doc_id", "text")), "text", "doc_id").withColumn("source_record_id", F.col("doc_id"))
    return X.deduplicate(e, F.struct("doc_id", "seq", "value")).select(F.concat_ws(":", "entity_type", "normalized_value").alias("id"), "source_record_id", "entity_type", "value")


def _members(spark, sf_dir):
    """(id, source_record_id): entities of every type with every document that names them."""
    e = X.extract(spread(table(prepare(spark), sf_dir, "documents").select("doc_id", "text")), "text", "doc_id")
    return e.select(F.concat_ws(":", "entity_type", "normalized_value").alias("id"), F.col("doc_id").alias("source_record_id")).distinct()


def graph_cooccurrence_edges(spark, sf_dir):
    """Edges between the entities of every document that names them, not of the first only; stars where a document names very many."""
    return G.linked(_members(spark, sf_dir))


def graph_star_edges(spark, sf_dir):
    """Edges from the entities to every document that names them."""
    return G.star(_members(spark, sf_dir))


def graph_document_edges(spark, sf_dir):
    """Edges between the entities of every type: pairs of a document, the star form where it names very many."""
    return G.linked(_all_entities(spark, sf_dir))


def graph_document_star(spark, sf_dir):
    """Edges from the entities of every type to their first document."""
    return G.star(_all_entities(spark, sf_dir))


def graph_edges_upsert(spark, sf_dir):
    """New edges, some repeated and some without an end, merged into the graph."""
    e = _edges(spark, sf_dir)
    new = e.where("type = 'PART_OF'").unionByName(e.where("type = 'LOCATED_IN'").select(F.col("src"), F.concat(F.col("dst"), F.lit("x")).alias("dst"), "type"))
    return G.upsert_edges(e.where("type = 'RESIDES_AT'"), new, _nodes(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"))


def graph_nodes_upsert(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    new = n.where("label = 'Country'").select("id", F.lit(None).cast("string").alias("value"), F.lit("City").alias("label")).unionByName(spark.createDataFrame([("x1", "new", "Entity")], "id string, value string, label string"))
    return G.upsert_nodes(n, new).select("id", "label", "value")


def graph_incident(spark, sf_dir):
    return G.incident(_edges(spark, sf_dir), "n7")


def graph_find(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return n.where((F.col("label") == "Country") & ((F.col("normalized_value") == "nation_7") | (F.col("value") == "AFRICA"))).orderBy("id").limit(1).select("id", "value")


def graph_search(spark, sf_dir):
    return G.search(_nodes(spark, sf_dir), "ion_1", "Country", "wsn").select("id", "value")


def graph_stats(spark, sf_dir):
    return G.stats(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def graph_neighbors(spark, sf_dir):
    """Paths of up to three edges from a region, all of them."""
    return G.neighbors(_edges(spark, sf_dir), "r1", 3, limit=None)


def graph_neighbors_typed(spark, sf_dir):
    return G.neighbors(_edges(spark, sf_dir), "n3", 2, ["PART_OF", "LOCATED_IN"], limit=100)


def graph_delete(spark, sf_dir):
    n, e = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    n2, e2 = G.delete_nodes(n, e, n.where("id in ('n1', 'n2', 'r3')"))
    return G.stats(n2, e2)


def graph_clear_workspace(spark, sf_dir):
    return G.stats(*G.clear_workspace(_nodes(spark, sf_dir), _edges(spark, sf_dir), "wsc"))


def graph_constraints(spark, sf_dir):
    """Edges whose ends break the declared labels, once every edge claims WORKS_AT."""
    e = _edges(spark, sf_dir).where("type <> 'PART_OF'").withColumn("type", F.lit("WORKS_AT"))
    return G.check_edges(_nodes(spark, sf_dir), e).groupBy("type").agg(F.count("*").alias("n"))


def graph_unique(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return G.check_unique(n.unionByName(n.where("label = 'Organization'")))


def graph_sql(spark, sf_dir):
    return G.run_sql(_nodes(spark, sf_dir), _edges(spark, sf_dir), "SELECT n.label, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.id GROUP BY n.label")


def graph_schema(spark, sf_dir):
    return G.schema(prepare(spark))


# ---- vectors --------------------------------------------------------------------


def _vectors(spark, sf_dir):
    return table(prepare(spark), sf_dir, "embeddings")


def _query(spark, sf_dir):
    return [float(x) for x in _vectors(spark, sf_dir).orderBy("vec_id").limit(1).collect()[0]["embedding"]]


def vector_topk(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10).select("vec_id", F.round("score", 5).alias("score"))


def vector_topk_filtered(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, label=3).select("vec_id", F.round("score", 5).alias("score"))


def vector_search(spark, sf_dir):
    """Ten nearest of every hundredth row, against all rows."""
    v = _vectors(spark, sf_dir)
    return V.search(v, v.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank")


def vector_stats(spark, sf_dir):
    return V.stats(_vectors(spark, sf_dir))


def vector_upsert(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", "label", F.lit(1).alias("indexed_at"))
    return V.upsert(v, v.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("indexed_at"))).groupBy("label").agg(F.count("*").alias("n"))


def hash_embedding(spark, sf_dir):
    """Embeddings of the nations' names: four components and the length."""
    n = table(prepare(spark), sf_dir, "nation").select("n_nationkey", V.hash_embedding(F.col("n_name")).alias("v"))
    return n.select("n_nationkey", *[F.round(F.get("v", F.lit(i)), 6).alias(f"c{i}") for i in (0, 31, 32, 383)], F.size("v").cast("bigint").alias("size"))


def entity_embeddings(spark, sf_dir):
    """Embeddings of the entities of every type: four components and the length."""
    e = _all_entities(spark, sf_dir).select("id", V.hash_embedding(V.embedding_text(F.col("entity_type"), F.col("value"))).alias("v"))
    return e.select("id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"c{i}") for i in (0, 31, 32, 383)], F.size("v").cast("bigint").alias("size"))


def vector_point_ids(spark, sf_dir):
    return table(prepare(spark), sf_dir, "entity_payloads").select("payload_id", V.point_id(F.col("id")).alias("point_id"))


def embedding_texts(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "entity_requests")
    return e.select("request_id", V.embedding_text(F.trim("entity_type"), F.col("value"), F.col("tags")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (graph_label_map, graph_export_nodes, graph_cooccurrence_edges, graph_star_edges, graph_document_edges, graph_document_star, graph_edges_upsert, graph_nodes_upsert, graph_incident, graph_find, graph_search, graph_stats, graph_neighbors, graph_neighbors_typed, graph_delete, graph_clear_workspace, graph_constraints, graph_unique, graph_sql, graph_schema,
              vector_topk, vector_topk_filtered, vector_search, vector_stats, vector_upsert, hash_embedding, entity_embeddings, vector_point_ids, embedding_texts)
}

# ---- SQL ------------------------------------------------------------------

_N = "nodes AS (" + " UNION ALL ".join(f"SELECT '{k[0]}' || {k} AS id, '{lab}' AS label, {v} AS value, lower({v}) AS normalized_value, 'ws{k[0]}' AS workspace_id FROM {t}" for t, k, v, lab in (("region", "r_regionkey", "r_name", "Country"), ("nation", "n_nationkey", "n_name", "Country"), ("supplier", "s_suppkey", "s_name", "Organization"), ("customer", "c_custkey", "c_name", "Person"))) + ")"
_E = "edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'RESIDES_AT' FROM customer)"
_LAB = "CASE translate(upper(trim(entity_type)), ' -', '__') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.TYPE_LABELS.items()) + " ELSE 'Entity' END"
_D1 = _FOUND + ", d AS (SELECT entity_type || ':' || normalized_value AS id, min(doc_id) AS r FROM found GROUP BY ALL)"
_DM = _FOUND + ", d AS (SELECT DISTINCT entity_type || ':' || normalized_value AS id, doc_id AS r FROM found)"
_LINKED = f"""big AS (SELECT r FROM d GROUP BY ALL HAVING count(*) >= {G.MANY}) SELECT a.id AS src, b.id AS dst, 'ASSOCIATED_WITH' AS type, a.r::VARCHAR AS source_record_id FROM d a JOIN d b ON a.r = b.r AND a.id < b.id WHERE a.r NOT IN (SELECT r FROM big)
    UNION ALL SELECT id, r::VARCHAR, 'EXTRACTED_FROM', r::VARCHAR FROM d WHERE r IN (SELECT r FROM big)"""
_STATS = "SELECT 'label' AS kind, label AS name, count(*) AS n FROM {n} GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM {e} GROUP BY ALL UNION ALL SELECT 'total', 'nodes', count(*) FROM {n} UNION ALL SELECT 'total', 'edges', count(*) FROM {e}"


def _paths(start: str, depth: int, cond: str) -> str:
    return f"""WITH RECURSIVE {_E}, x AS (SELECT concat_ws('|', src, type, dst) AS eid, src, dst FROM edges WHERE {cond}), w AS (SELECT eid, src AS a, dst AS b FROM x UNION ALL SELECT eid, dst, src FROM x WHERE src <> dst),
        p AS (SELECT b, [eid] AS path FROM w WHERE a = '{start}' UNION ALL SELECT w.b, list_append(p.path, w.eid) FROM p JOIN w ON p.b = w.a WHERE len(p.path) < {depth} AND NOT list_contains(p.path, w.eid))
        SELECT b AS node_id, len(path)::BIGINT AS depth, path FROM p"""


_Q0 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_HB = "('0x' || substr(sha256(lower(n_name) || (j // 32)::VARCHAR), ((j % 32) * 2 + 1)::INT, 2))::INT / 127.5 - 1"
SQL = {
    "graph_label_map": f"SELECT trim(entity_type) AS entity_type, {_LAB} AS label, count(*) AS n FROM entity_requests GROUP BY ALL",
    "graph_export_nodes": f"SELECT entity_id AS id, {_LAB} AS label, value, workspace_id, entity_type AS meta_kind, 1::BIGINT AS n_properties FROM (SELECT entity_id, arg_min(entity_type, request_id) AS entity_type, arg_min_null(value, request_id) AS value, arg_min(workspace_id, request_id) AS workspace_id FROM entity_requests WHERE entity_id IS NOT NULL GROUP BY ALL)",
    "graph_cooccurrence_edges": f"WITH {_DM}, {_LINKED}",
    "graph_star_edges": f"WITH {_DM} SELECT id AS src, r AS dst, 'EXTRACTED_FROM' AS type FROM d",
    "graph_document_edges": f"WITH {_D1}, {_LINKED}",
    "graph_document_star": f"WITH {_D1} SELECT id AS src, r AS dst, 'EXTRACTED_FROM' AS type FROM d",
    "vector_point_ids": "SELECT payload_id, (('0x' || substr(sha1(unhex('" + V.NAMESPACE + "') || encode(id)), 17, 16))::UBIGINT & 4611686018427387903::UBIGINT)::BIGINT AS point_id FROM entity_payloads",
    "graph_edges_upsert": f"WITH {_E} SELECT type, count(*) AS n FROM edges WHERE type <> 'LOCATED_IN' GROUP BY ALL",
    "graph_nodes_upsert": f"WITH {_N} SELECT id, CASE WHEN label = 'Country' THEN 'City' ELSE label END AS label, value FROM nodes UNION ALL SELECT 'x1', 'Entity', 'new'",
    "graph_incident": f"WITH {_E} SELECT 'n7' AS source_id, dst AS other_id, type, true AS out FROM edges WHERE src = 'n7' UNION ALL SELECT 'n7', src, type, false FROM edges WHERE dst = 'n7' AND src <> dst",
    "graph_find": f"WITH {_N} SELECT id, value FROM nodes WHERE label = 'Country' AND (normalized_value = 'nation_7' OR value = 'AFRICA') ORDER BY id LIMIT 1",
    "graph_search": f"WITH {_N} SELECT id, value FROM nodes WHERE (contains(lower(value), 'ion_1') OR contains(normalized_value, 'ion_1')) AND label = 'Country' AND workspace_id = 'wsn' ORDER BY id LIMIT 50",
    "graph_stats": f"WITH {_N}, {_E} {_STATS.format(n='nodes', e='edges')}",
    "graph_neighbors": f"SELECT node_id, depth FROM ({_paths('r1', 3, "true")})",
    "graph_neighbors_typed": f"SELECT node_id, depth FROM ({_paths('n3', 2, "type IN ('PART_OF', 'LOCATED_IN')")}) ORDER BY depth, path LIMIT 100",
    "graph_delete": f"WITH {_N}, {_E}, n2 AS (SELECT * FROM nodes WHERE id NOT IN ('n1', 'n2', 'r3')), e2 AS (SELECT * FROM edges WHERE src NOT IN ('n1', 'n2', 'r3') AND dst NOT IN ('n1', 'n2', 'r3')) {_STATS.format(n='n2', e='e2')}",
    "graph_clear_workspace": f"WITH {_N}, {_E}, n2 AS (SELECT * FROM nodes WHERE workspace_id <> 'wsc'), e2 AS (SELECT * FROM edges WHERE type <> 'RESIDES_AT') {_STATS.format(n='n2', e='e2')}",
    "graph_constraints": f"WITH {_E} SELECT 'WORKS_AT' AS type, count(*) AS n FROM edges WHERE type <> 'PART_OF'",
    "graph_unique": "SELECT 's' || s_suppkey AS id, 2::BIGINT AS n FROM supplier",
    "graph_sql": f"WITH {_N}, {_E} SELECT n.label, count(*) AS n FROM edges e JOIN nodes n ON e.src = n.id GROUP BY n.label",
    "graph_schema": " UNION ALL ".join([f"SELECT 'label' AS kind, '{x}' AS name" for x in G.LABELS] + [f"SELECT 'relationship', '{x}'" for x in G.RELATIONS]),
    "vector_topk": f"SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, {_SIM} AS s FROM embeddings e, {_Q0} q) ORDER BY s DESC, vec_id LIMIT 10",
    "vector_topk_filtered": f"SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, {_SIM} AS s FROM embeddings e, {_Q0} q WHERE label = 3) ORDER BY s DESC, vec_id LIMIT 10",
    "vector_search": f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10",
    "vector_stats": "SELECT count(*) AS points, count(embedding) AS indexed, max(len(embedding))::BIGINT AS dimension, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings",
    "vector_upsert": "SELECT label, count(*) AS n FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings) GROUP BY ALL",
    "entity_embeddings": f"WITH {_FIRST}, e AS (SELECT entity_type || ':' || normalized_value AS id, lower(concat_ws(' ', nullif(entity_type, ''), nullif(value, ''))) AS n_name FROM firsts), v AS (SELECT id, list_transform(range(384), lambda j: {_HB}) AS v FROM e), w AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS d FROM v) SELECT id, round(v[1] / d, 6) AS c0, round(v[32] / d, 6) AS c31, round(v[33] / d, 6) AS c32, round(v[384] / d, 6) AS c383, len(v)::BIGINT AS size FROM w",
    "hash_embedding": f"WITH v AS (SELECT n_nationkey, list_transform(range(384), lambda j: {_HB}) AS v FROM nation), w AS (SELECT n_nationkey, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS d FROM v) SELECT n_nationkey, round(v[1] / d, 6) AS c0, round(v[32] / d, 6) AS c31, round(v[33] / d, 6) AS c32, round(v[384] / d, 6) AS c383, len(v)::BIGINT AS size FROM w",
    "embedding_texts": "SELECT request_id, concat_ws(' ', nullif(trim(entity_type), ''), nullif(value, ''), nullif(array_to_string(list_sort(tags), ' '), '')) AS text FROM entity_requests",
}
