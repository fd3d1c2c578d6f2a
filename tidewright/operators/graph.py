"""A property graph as two frames: nodes (id, label, ...) and edges (src, dst, type, ...)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Node labels and relationship types. (fixed values)
LABELS = (
    "Person",
    "Organization",
    "Email",
    "Domain",
    "IPAddress",
    "Phone",
    "URL",
    "Username",
    "SocialMedia",
    "Cryptocurrency",
    "Address",
    "Country",
    "City",
    "Hash",
    "File",
    "Malware",
    "CVE",
    "BankAccount",
    "CreditCard",
    "Document",
    "Credential",
    "ThreatActor",
    "Campaign",
    "Indicator",
    "Entity",
)
RELATIONS = (
    "USES_EMAIL",
    "USES_PHONE",
    "USES_USERNAME",
    "HAS_SOCIAL_MEDIA",
    "WORKS_AT",
    "MEMBER_OF",
    "LEADS",
    "OWNS",
    "OWNS_DOMAIN",
    "REGISTERED_TO",
    "HOSTED_ON",
    "RESOLVES_TO",
    "SENT_FROM",
    "SENT_TO",
    "COMMUNICATED_WITH",
    "LOCATED_IN",
    "RESIDES_AT",
    "OPERATES_IN",
    "IMPERSONATES",
    "TARGETS",
    "ATTRIBUTED_TO",
    "ASSOCIATED_WITH",
    "PART_OF",
    "CONTAINS",
    "EXTRACTED_FROM",
    "CONNECTS_TO",
    "DERIVED_FROM",
    "OWNS_ACCOUNT",
    "TRANSACTED_WITH",
    "PAID_TO",
    "RECEIVED_FROM",
    "RELATED_TO",
    "SAME_AS",
    "SIMILAR_TO",
)
#: Label of an entity type in capitals; others are ``Entity``. (fixed values)
TYPE_LABELS = {
    "EMAIL": "Email", "EMAIL_ADDRESS": "Email", "DOMAIN": "Domain", "DOMAIN_NAME": "Domain", "IP": "IPAddress", "IP_ADDRESS": "IPAddress", "IPADDRESS": "IPAddress", "IPV4": "IPAddress",
    "PHONE": "Phone", "PHONE_NUMBER": "Phone", "PERSON": "Person", "NAME": "Person", "ORGANIZATION": "Organization", "ORG": "Organization", "URL": "URL", "LINK": "URL", "USERNAME": "Username", "USER": "Username",
    "HASH": "Hash", "MD5": "Hash", "SHA256": "Hash", "CRYPTOCURRENCY": "Cryptocurrency", "BITCOIN": "Cryptocurrency", "THREAT_ACTOR": "ThreatActor", "APT": "ThreatActor",
}
#: Relationships with declared ends (None: any). (fixed values)
DEFINITIONS = {
    "USES_EMAIL": (("Person", "Organization"), ("Email",)),
    "WORKS_AT": (("Person",), ("Organization",)),
    "OWNS_DOMAIN": (("Person", "Organization"), ("Domain",)),
    "IMPERSONATES": (("ThreatActor", "Person", "Email"), ("Person", "Organization", "Email")),
    "ASSOCIATED_WITH": (None, None),
}


def label(entity_type: Column) -> Column:
    t = F.translate(F.upper(entity_type), " -", "__")
    m = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(m[t], F.lit("Entity"))


def properties(metadata: Column) -> Column:
    """Scalar metadata flattened to ``meta_<key>``; nulls are dropped."""
    return F.transform_keys(F.map_filter(metadata, lambda k, v: v.isNotNull()), lambda k, v: F.concat(F.lit("meta_"), k))


def upsert_normal(value: Column) -> Column:
    """Normal form of a value that is upserted on its own: small letters, no blanks around."""
    return F.trim(F.lower(value))


def upsert_with_relations(nodes_: DataFrame, edges: DataFrame, new: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) after entities (id, entity_type, value, workspace_id) and their relations (src, dst[, type]).

    A relation without a type is RELATED_TO and counts only if its target is
    there.  The report has (entity_id, relationship_count) of each new entity.
    """
    n = new.select("id", label(F.col("entity_type")).alias("label"), "value", upsert_normal(F.col("value")).alias("normalized_value"), "workspace_id")
    merged = upsert_nodes(nodes_, n)
    kind = F.coalesce("type", F.lit("RELATED_TO")) if "type" in relations.columns else F.lit("RELATED_TO")
    rel = relations.select("src", "dst", kind.alias("type")).join(new.select(F.col("id").alias("src")), "src", "left_semi")
    kept = upsert_edges(edges.limit(0), rel, merged)
    count = new.select(F.col("id").alias("entity_id")).join(kept.groupBy(F.col("src").alias("entity_id")).agg(F.count("*").alias("n")), "entity_id", "left")
    return merged, upsert_edges(edges, rel, merged), count.select("entity_id", F.coalesce("n", F.lit(0)).alias("relationship_count"))


def export_report(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (entities_exported, errors, relationships_created): an entity without id, type or value can't be exported."""
    bad = F.col("id").isNull() | F.col("entity_type").isNull() | F.col("value").isNull()
    n = entities.agg(F.count_if(~bad).alias("entities_exported"), F.count_if(bad).alias("errors"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("relationships_created"))), F.lit(True))


def nodes(entities: DataFrame, entity_id: Column) -> DataFrame:
    keep = [c for c in ("value", "normalized_value", "confidence", "threat_level", "source", "workspace_id", "tags") if c in entities.columns]
    extra = [properties(F.col("metadata")).alias("properties")] if "metadata" in entities.columns else []
    return entities.select(entity_id.alias("id"), label(F.col("entity_type")).alias("label"), *keep, *extra)


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes merged by id; a new property wins where it isn't null."""
    j = stored.alias("a").join(new.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer")
    return j.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in stored.columns])


def upsert_edges(stored: DataFrame, new: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Edges merged by (src, dst, type); new ones count only if both ends exist."""
    ids = node_ids.select("id").distinct()
    ok = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return stored.unionByName(ok.select(*stored.columns)).dropDuplicates(["src", "dst", "type"])


def cooccurrence(entities: DataFrame, record: str = "source_record_id", entity_id: str = "id") -> DataFrame:
    """ASSOCIATED_WITH edges between the entities of one record, src < dst.

    An entity belongs to one record only (its first), so the pairs of a record
    are those of its own entities.  For records that name very many entities
    use :func:`star`, which is linear and links the same entities in two hops.
    """
    e = entities.where(F.col(record).isNotNull()).select(F.col(record).alias("r"), F.col(entity_id).alias("e")).distinct()
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.e") < F.col("b.e"))).select(F.col("a.e").alias("src"), F.col("b.e").alias("dst"), F.lit("ASSOCIATED_WITH").alias("type"), F.col("a.r").alias("source_record_id"))


def star(entities: DataFrame, record: str = "source_record_id", entity_id: str = "id") -> DataFrame:
    """EXTRACTED_FROM edges from entities to their record: one per entity and record."""
    return entities.where(F.col(record).isNotNull()).select(F.col(entity_id).alias("src"), F.col(record).alias("dst"), F.lit("EXTRACTED_FROM").alias("type")).distinct()


#: Entities of one record from which on the star stands for its pairs.
MANY = 256


def linked(entities: DataFrame, record: str = "source_record_id", entity_id: str = "id", many: int = MANY) -> DataFrame:
    """(src, dst, type, source_record_id): pairs of the entities of a record, and stars for records of ``many`` entities or more.

    No record is left out and the edges grow in proportion to the entities: at
    most ``many`` / 2 an entity.  The sizes come from one more aggregate.
    """
    e = entities.where(F.col(record).isNotNull()).select(F.col(record).alias(record), F.col(entity_id).alias(entity_id)).distinct()
    e = materialize(e, "linked")
    large = e.groupBy(record).agg(F.count("*").alias("n")).where(F.col("n") >= many).select(record)
    pairs = cooccurrence(e.join(large, record, "left_anti"), record, entity_id)
    stars = star(e.join(large, record, "left_semi"), record, entity_id)
    return pairs.select(F.col("src"), F.col("dst").cast("string").alias("dst"), "type", F.col("source_record_id").cast("string").alias("source_record_id")).unionByName(stars.select("src", F.col("dst").cast("string").alias("dst"), "type", F.col("dst").cast("string").alias("source_record_id")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(eid, a, b, type, out): every edge from either end; eid names the edge."""
    e = edges.withColumn("eid", F.concat_ws("|", "src", "type", "dst"))
    there = e.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), "type", F.lit(True).alias("out"))
    back = e.where("src <> dst").select("eid", F.col("dst").alias("a"), F.col("src").alias("b"), "type", F.lit(False).alias("out"))
    return there.unionByName(back)


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    """(source_id, other_id, type, out) of a node's edges, whichever way they point."""
    return both_ways(edges).where(F.col("a") == node_id).select(F.col("a").alias("source_id"), F.col("b").alias("other_id"), "type", "out")


def neighbors(edges: DataFrame, node_id: str, depth: int = 1, types: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    """(node_id, depth), one row per path of 1 to ``depth`` (at most 3) edges; no path repeats an edge, nodes may come again.

    Each hop joins the frontier with the edges; the first is a filter.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    e = both_ways(edges if types is None else edges.where(F.col("type").isin(types)))
    front = e.where(F.col("a") == node_id).select("b", F.array("eid").alias("path"))
    out = front.select(F.col("b").alias("node_id"), F.lit(1).cast("bigint").alias("depth"), "path")
    for d in range(2, depth + 1):
        step = e.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("eid").alias("z"))
        front = front.join(step, F.col("b") == F.col("x")).where(~F.array_contains("path", F.col("z"))).select(F.col("y").alias("b"), F.array_append("path", F.col("z")).alias("path"))
        out = out.unionByName(front.select(F.col("b").alias("node_id"), F.lit(d).cast("bigint").alias("depth"), "path"))
    if limit is not None:
        out = out.orderBy("depth", "path").limit(limit)
    return out.select("node_id", "depth")


def search(nodes_: DataFrame, term: str, label_: str | None = None, workspace_id: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose value or normal form contains the term, in a workspace and of a label if given, by id."""
    low = F.lit(term.lower())
    hit = F.contains(F.lower("value"), low) | F.contains(F.lower("normalized_value"), low)
    if label_ is not None:
        hit = hit & (F.col("label") == label_)
    if workspace_id is not None:
        hit = hit & (F.col("workspace_id") == workspace_id)
    return nodes_.where(hit).orderBy("id").limit(min(limit, 500))


def stats(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes and edges in all, per label and per type."""
    n = nodes_.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    e = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    total = lambda df, k: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), F.lit(k).alias("name"), "n")
    return n.unionByName(e).unionByName(total(n, "nodes")).unionByName(total(e, "edges"))


def delete_nodes(nodes_: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes in ``gone`` (id) and all their edges."""
    g = gone.select("id").distinct()
    e = edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes_.join(g, "id", "left_anti"), e


def clear_workspace(nodes_: DataFrame, edges: DataFrame, workspace_id: str) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes_, edges, nodes_.where(F.col("workspace_id") == workspace_id))


def check_unique(nodes_: DataFrame) -> DataFrame:
    """(id, n) of ids that occur more than once: what a uniqueness constraint would refuse."""
    return nodes_.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def check_edges(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends don't have the labels that their type declares."""
    spark = nodes_.sparkSession
    rules = spark.createDataFrame([(t, list(a or LABELS), list(b or LABELS)) for t, (a, b) in DEFINITIONS.items()], "type string, sources array<string>, targets array<string>")
    n = nodes_.select("id", "label")
    j = edges.join(F.broadcast(rules), "type").join(n.select(F.col("id").alias("src"), F.col("label").alias("sl")), "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("dl")), "dst")
    return j.where(~F.array_contains("sources", F.col("sl")) | ~F.array_contains("targets", F.col("dl"))).select("src", "dst", "type")


def schema(spark) -> DataFrame:
    """(kind, name) of all labels and relationship types."""
    return spark.createDataFrame([("label", x) for x in LABELS] + [("relationship", x) for x in RELATIONS], "kind string, name string")


def run_sql(nodes_: DataFrame, edges: DataFrame, sql: str) -> DataFrame:
    """A read-only query over ``nodes`` and ``edges``; anything but one SELECT is refused."""
    text = sql.strip().rstrip(";")
    if not re.match(r"(?is)^(select|with)\b", text) or ";" in text or re.search(r"(?i)\b(insert|update|delete|drop|create|alter|truncate|merge|set|cache|use)\b", re.sub(r"'(?:[^']|'')*'", "", text)):
        raise ValueError("only a single SELECT is allowed")
    a, b = (f"{k}_{uuid.uuid4().hex}" for k in ("nodes", "edges"))
    nodes_.createOrReplaceTempView(a)
    edges.createOrReplaceTempView(b)
    return nodes_.sparkSession.sql(re.sub(r"\bedges\b", b, re.sub(r"\bnodes\b", a, text)))
