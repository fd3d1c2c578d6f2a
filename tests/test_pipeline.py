"""The pipeline from records to frames, the object store, and cleaning up."""

import datetime as dt

import pytest

from tidewright.operators import pipeline
from tidewright.session import scratch
from tidewright.sources.objects import ObjectStore, raw_key


def test_ingest_is_idempotent(spark):
    rows = [("r1", "w", dt.datetime(2025, 1, 1), '{"note":"Mail bob@x.example from 10.0.0.1"}'), ("r2", "w", dt.datetime(2025, 1, 2), '{"note":"BOB@x.example"}'), ("r3", "v", None, "{cut")]
    df = spark.createDataFrame(rows, "id string, workspace_id string, created_at timestamp_ntz, data string")
    a = pipeline.ingest(df)
    got = {(r.entity_type, r.normalized_value): r for r in a.entities.collect()}
    assert got["email", "bob@x.example"].source_record_id == "r1" and got["ip_address", "10.0.0.1"].threat_level == "high"
    b = pipeline.ingest(df, a.entities)
    assert sorted(map(str, b.entities.collect())) == sorted(map(str, a.entities.collect()))
    n = a.entities.count()
    assert a.nodes.count() == n == a.vectors.count() and a.review.count() == 0 and a.events.first().subject == "events.ingestion.complete"
    assert a.edges.count() >= 3
    e = pipeline.ingest(df.limit(0))
    assert e.entities.count() == 0 and e.edges.count() == 0
    assert pipeline.push(spark, [{"a": 1}, {"a": 1}], "w", "s").select("id").distinct().count() == 2


def test_objects(spark):
    s = ObjectStore(spark, scratch(spark, "objects"))
    s.ensure()
    s.put("raw", raw_key("w", "j", "a.csv"), b"x\n1\n")
    assert s.get("raw", "w/j/a.csv") == b"x\n1\n" and s.list("raw").count() == 1
    assert s.delete("raw", "w/j/a.csv") and not s.delete("raw", "w/j/a.csv")
    for bad in (("nope", "x"), ("raw", "../x")):
        with pytest.raises(ValueError):
            s.put(*bad, b"")
