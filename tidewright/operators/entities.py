"""Entities found in texts and records: extract, deduplicate, enrich, tag, upsert."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entity as E
from ..functions import jsontext as J

#: The columns of an entity table.
COLUMNS = ("workspace_id", "entity_type", "normalized_value", "value", "source", "source_record_id", "confidence", "threat_level", "tags", "metadata", "first_seen", "last_seen")


def extract_type(df: DataFrame, text: str, entity_type: str, *keep: str) -> DataFrame:
    """(keep..., value): one row per distinct match of one type in each text."""
    return df.select(*keep, F.explode(E.matches(F.col(text), entity_type)).alias("value"))


def extract(df: DataFrame, text: str, *keep: str, source: Column | None = None) -> DataFrame:
    """(keep..., seq, entity_type, value, normalized_value[, source]) of every type; overlapping types all fire."""
    rows = df.select(*keep, *([source.alias("source")] if source is not None else []), F.explode(E.all_matches(F.col(text))).alias("m"))
    rows = rows.select(*keep, *(["source"] if source is not None else []), "m.*")
    return rows.withColumn("normalized_value", E.normalize(F.col("entity_type"), F.col("value")))


def walk_strings(df: DataFrame, data: str, *keep: str, label: str = "") -> DataFrame:
    """(keep..., path, text): every string in a JSON object with the path of its key.

    Strings in lists carry their position; a list inside a list isn't entered,
    numbers aren't scanned.  Unreadable data gives no row.
    """
    rows = df.select(F.struct(*keep).alias("k"), F.col(data).alias("d")).where("d is not null")

    def run(it):
        for b in it:
            at, paths, texts = [], [], []

            for i, t in enumerate(b.column(1).to_pylist()):
                v = J.read(t)
                stack = [("", v)] if isinstance(v, dict) else []
                while stack:  # a stack of our own, so any depth that can be parsed will do
                    prefix, v = stack.pop()
                    for k, x in v.items():
                        p = f"{prefix}.{k}" if prefix else k
                        for q, y in [(f"{p}[{n}]", y) for n, y in enumerate(x)] if isinstance(x, list) else [(p, x)]:
                            if type(y) is str:
                                at.append(i), paths.append(q), texts.append(y)
                            elif isinstance(y, dict):
                                stack.append((q, y))

            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), J.strings([label + p for p in paths]), J.strings(texts)], names=["k", "path", "text"])

    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, path string, text string")
    return out.select("k.*", "path", "text")


def extract_from_records(df: DataFrame, data: str, *keep: str, label: str = "") -> DataFrame:
    """Entities in every string of JSON records, ``source`` being label and key path."""
    found = walk_strings(df, data, *keep, label=label)
    return extract(found, "text", *keep, source=F.col("path"))


def deduplicate(entities: DataFrame, order: Column, by: tuple[str, ...] = ("entity_type", "normalized_value")) -> DataFrame:
    """One row per type and normal form: the first row by ``order`` gives value, source and first_seen.

    Tags are united, metadata merged with the later row winning, confidence and
    last_seen are maxima.  Columns that are absent are left out; a key with a
    third of all rows is combined in the tasks first.
    """
    have = set(entities.columns) - set(by)
    order, mention = order.alias("_order"), F.count("*")
    if "tags" in have:  # one row per tag, so that what a group collects is its tags and not every list of them
        entities = entities.select("*", order, F.posexplode_outer("tags").alias("_at", "_tag"))
        order, mention = F.col("_order"), F.count_if(F.col("_at").isNull() | (F.col("_at") == 0))
    aggs = [F.min_by(c, order).alias(c) for c in ("value", "source", "source_record_id", "first_seen", "threat_level") if c in have]
    aggs += [F.max(c).alias(c) for c in ("confidence", "last_seen") if c in have]
    if "tags" in have:
        aggs.append(F.array_sort(F.collect_set("_tag")).alias("tags"))
    out = entities.groupBy(*by).agg(*aggs, mention.alias("n_mentions"))
    if "metadata" in have:
        # The last value of each key, so a group is as long as its keys are many.
        once = entities.where(F.col("_at").isNull() | (F.col("_at") == 0)) if "tags" in have else entities
        e = once.select(*by, order.alias("_o"), F.explode("metadata").alias("_k", "_v"))
        m = e.groupBy(*by, "_k").agg(F.max_by("_v", "_o").alias("_v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("metadata"))
        out = out.join(m, list(by), "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return out


def enrich(entities: DataFrame) -> DataFrame:
    """Metadata from the value, and a threat level where none is set."""
    t, n = F.col("entity_type"), F.col("normalized_value")
    have = entities.columns
    level = E.threat(t, n, F.col("tags") if "tags" in have else None)
    out = entities.withColumn("threat_level", F.coalesce(F.col("threat_level"), level) if "threat_level" in have else level)
    own = E.enrichment(t, n)
    return out.withColumn("metadata", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), own) if "metadata" in have else own)


def tag(entities: DataFrame, tags: Column) -> DataFrame:
    """Add tags and always recompute the threat level."""
    out = entities.withColumn("tags", E.union_tags(F.col("tags"), tags))
    return out.withColumn("threat_level", E.threat(F.col("entity_type"), F.col("normalized_value"), F.col("tags")))


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("workspace_id", "entity_type", "normalized_value")) -> DataFrame:
    """Stored entities with new ones merged in: one full outer join on the key.

    A known entity keeps value, source and first_seen, takes the new last_seen
    and a new threat level if there is one, the higher confidence, all tags,
    and new metadata over old.  ``new`` must be deduplicated.
    """
    a, b = stored.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    pick = lambda c, first="a": F.coalesce(F.col(f"{first}.{c}"), F.col(f"{'b' if first == 'a' else 'a'}.{c}"))
    none = F.create_map().cast("map<string,string>")
    how = {
        "last_seen": pick("last_seen", "b"),
        "threat_level": pick("threat_level", "b"),
        "confidence": F.greatest("a.confidence", "b.confidence"),
        "tags": E.union_tags(F.col("a.tags"), F.col("b.tags")),
        "metadata": F.map_from_entries(F.map_entries(F.map_concat(F.coalesce("a.metadata", none), F.coalesce("b.metadata", none)))),
    }
    return joined.select(*[how.get(c, pick(c)).alias(c) for c in stored.columns])


def find(entities: DataFrame, workspace_id: str, entity_type: str, normalized_value: str) -> DataFrame:
    """The entity of a key, none or one row."""
    return entities.where((F.col("workspace_id") == workspace_id) & (F.col("entity_type") == entity_type) & (F.col("normalized_value") == normalized_value)).limit(1)
