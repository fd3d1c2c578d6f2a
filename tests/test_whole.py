"""Queries that must do the whole job: every record, type, column and message."""

from collections import Counter

from pyspark.sql import functions as F

from tidewright.operators import entities as X
from tidewright.operators import graph as G
from tidewright.plans import catalog
from tidewright.session import table

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_over_all_records(spark):
    got = catalog.QUERIES["pipeline_ingest"](spark, SF).collect()
    n = Counter()
    for r in got:
        n[r.part] += r.n
    rec = table(spark, SF, "data_records").select("id", "workspace_id", "created_at", "data")
    found = X.extract_from_records(rec, "data", "id", "workspace_id", "created_at").select("workspace_id", "entity_type", "normalized_value", "created_at", "id").collect()
    first = {}
    for r in found:
        k = tuple(r[:3])
        first[k] = min(first.get(k, (r.created_at, r.id)), (r.created_at, r.id))
    own = Counter(first.values())
    assert n["entities"] == n["nodes"] == n["vectors"] == len(first) > 100
    assert n["edges"] == sum(m * (m - 1) // 2 for m in own.values()) > 0 and n["review"] == 0
    assert {(r.kind, r.n) for r in got if r.part == "events"} == {("events.ingestion.complete", 1)}


def test_graph_has_every_type(spark):
    docs = table(spark, SF, "documents")
    found = X.extract(docs, "text", "doc_id").select("entity_type", "normalized_value", "doc_id").collect()
    first = {}
    for t, v, d in found:
        k = f"{t}:{v}"
        first[k] = min(first.get(k, d), d)
    star = catalog.QUERIES["graph_document_star"](spark, SF).collect()
    assert {(r.src, r.dst) for r in star} == set(first.items()) and len(star) == len(first)
    kinds = {k.split(":")[0] for k in first}
    assert kinds > {"email", "ip_address", "social_handle"}
    size = Counter(first.values())
    edges = catalog.QUERIES["graph_document_edges"](spark, SF)
    assert edges.count() == sum(n if n >= G.MANY else n * (n - 1) // 2 for n in size.values())
    assert {r.id for r in catalog.QUERIES["entity_embeddings"](spark, SF).select("id").collect()} == set(first)


def test_star_stands_for_many_pairs(spark):
    e = spark.createDataFrame([("r1", f"e{i}") for i in range(5)] + [("r2", "x"), ("r2", "y")], "source_record_id string, id string")
    got = G.linked(e, many=5).collect()
    assert sorted((r.src, r.dst, r.type) for r in got) == [(f"e{i}", "r1", "EXTRACTED_FROM") for i in range(5)] + [("x", "y", "ASSOCIATED_WITH")]
    assert G.linked(e, many=6).count() == 11


def test_profile_has_every_column_and_its_range(spark):
    got = {(r.table_name, r.column_name): r for r in catalog.QUERIES["p5_profile"](spark, SF).collect()}
    for name in ("ingestion_jobs", "data_records"):
        df = table(spark, SF, name)
        assert {c for t, c in got if t == name} == set(df.columns)
        for c in df.columns:
            want = df.agg(F.count("*"), F.count_if(F.col(c).isNull()), F.countDistinct(c), F.min(c).cast("string"), F.max(c).cast("string")).first()
            r = got[name, c]
            assert (r.n_rows, r.n_nulls, r.distinct_values, r.min_value, r.max_value) == tuple(want), (name, c)


def test_streams_have_messages_without_id(spark, rows):
    m = table(spark, SF, "event_messages")
    assert m.where("event_id is null or trim(event_id) = ''").count() > 0
    want = m.where("event_type like 'entity.%'").groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert rows(catalog.QUERIES["stream_subject_counts_whole"](spark, SF)) == rows(want)
    want = m.where("try_parse_json(payload) is not null").groupBy("event_type").agg(F.count("*").alias("n"))
    assert rows(catalog.QUERIES["stream_ingest_whole"](spark, SF)) == rows(want)
