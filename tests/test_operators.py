"""Operators that queries alone don't try out: skew, cycles, late data, retries, edge cases."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import compliance, entities, graph, ranges, schema, sinks, vectors
from tidewright.plans.extensions import asof
from tidewright.session import scratch
from tidewright.sources import connectors, files, objects
from tidewright.streaming import events


def test_ancestors_of_long_chains_and_cycles(spark, rows):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(200)]
    data = chain + [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "x"), ("y", None), (None, "z")]
    got = {(r, p): d for r, p, d in rows(compliance.ancestors(spark.createDataFrame(data, "record_id string, parent_record_id string")))}
    assert all(got[f"c{i}", f"c{j}"] == j - i for i in range(0, 200, 17) for j in range(i + 1, 201, 13))
    assert {k: v for k, v in got.items() if k[0] in "abcxyz"} == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}
    assert compliance.ancestors(spark.createDataFrame([], "record_id string, parent_record_id string")).count() == 0


def test_export_checksum(spark):
    log = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("checksum"))
    one = compliance.export_checksum(log, "id").first()
    assert one == compliance.export_checksum(log.repartition(7).orderBy(F.desc("checksum")), "id").first() and one.n == 2000
    assert compliance.export_checksum(log.where("id <> 5"), "id").first().export_checksum != one.export_checksum
    assert compliance.export_checksum(log.union(log.where("id = 6")), "id").first().export_checksum != one.export_checksum
    assert compliance.export_checksum(log.limit(0), "id").first().n == 0


def test_report_of_a_range_keeps_integrity(spark):
    t = dt.datetime(2025, 1, 1)
    log = compliance.log_action(spark.createDataFrame([(1, t, "a", "r", 1), (2, t + dt.timedelta(days=9), "b", "r", None)], "id int, timestamp timestamp_ntz, action string, resource_type string, user_id int"), ["id", "action"])
    got = {(r.section, r.key): r.n for r in compliance.report(log, ["id", "action"], end=t).collect()}
    assert got == {("action", "a"): 1, ("resource", "r"): 1, ("user", "1"): 1, ("hour", "2025-01-01 00:00"): 1, ("total", "events"): 1, ("integrity", "valid"): 2, ("integrity", "invalid"): 0}


def test_range_joins_against_all_pairs(spark, rows):
    rng = random.Random(3)
    p = [(i, rng.choice([None, 7.0, rng.uniform(-50, 50)])) for i in range(120)]
    r = [(i, lo, lo + rng.choice([-1, 0, 3, 70])) for i in range(40) for lo in [rng.uniform(-60, 60)]] + [(99, None, 1.0), (98, 7.0, 7.0)]
    a, b = spark.createDataFrame(p, "i int, x double"), spark.createDataFrame(r, "j int, lo double, hi double")
    want = sorted(((i, j) for i, x in p for j, lo, hi in r if x is not None and lo is not None and lo <= x <= hi), key=str)
    for width in (1.0, 10.0, 1000.0):
        assert rows(ranges.range_join(a, b, "x", "lo", "hi", width).select("i", "j")) == want
    c = b.select(F.col("j").alias("k"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    want = sorted(((j, k) for j, lo, hi in r for k, u, v in r if None not in (lo, u) and lo <= hi and u <= v and lo <= v and u <= hi), key=str)
    assert rows(ranges.interval_join(b, c, 10.0, ("lo", "hi"), ("a", "b")).select("j", "k")) == want


def test_asof_across_spans(spark, rows):
    t = dt.datetime(2025, 1, 1)
    rng = random.Random(5)
    right = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", t + dt.timedelta(hours=rng.randrange(400)), i) for i in range(60)]
    right = list({(k, a): (k, a, v) for k, a, v in right}.values())
    left = [(i, rng.choice(["hot", "k0", "none"]), t + dt.timedelta(hours=rng.randrange(500))) for i in range(80)]
    want = sorted(((i, max(((a, v) for q, a, v in right if q == k and a <= at), default=(0, None))[1]) for i, k, at in left), key=str)
    got = asof(spark.createDataFrame(left, "i int, k string, at timestamp_ntz"), spark.createDataFrame(right, "k string, at timestamp_ntz, v int"), "k", "at", "v")
    assert rows(got.select("i", "v")) == want


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.normal(size=8).tolist()) for i in range(500)] + [(900, [0.0] * 8), (901, None), (902, []), (903, [1.0] * 3)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").repartition(5)
    q = df.where("vec_id % 100 = 0 or vec_id = 903")
    x = np.array([e for _, e in v[:500]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: set(np.argsort(-(x @ x[i]))[:5]) for i in range(0, 500, 100)}
    got = {}
    for r in vectors.search(df, q, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == want | {903: {903}}
    cells = vectors.fit_cells(df, cells=8)
    near = vectors.search_cells(df, q.where("vec_id < 900"), cells, 5, probes=8)
    assert vectors.recall(vectors.search(df, q.where("vec_id < 900"), 5), near).first().recall == 1.0  # all cells
    none = df.limit(0)
    assert vectors.search(none, q).count() == 0 and vectors.search(df, none).count() == 0 and vectors.search_cells(none, q, vectors.fit_cells(none)).count() == 0


def test_a_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 50)
    rng = np.random.default_rng(3)
    v = [(i, (np.array([1.0, 0, 0, 0]) + 0.01 * rng.normal(size=4)).tolist()) for i in range(400)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    q = df.where("vec_id % 100 = 0")
    assert vectors.recall(vectors.search(df, q), vectors.search_cells(df, q, vectors.fit_cells(df, cells=2), probes=2)).first().recall == 1.0


def test_tags_are_united(spark):
    e = spark.createDataFrame([("t", "n", 1, ["b", "a"], {"k": "1"}), ("t", "n", 2, ["b"], {"k": "2", "z": "0"}), ("t", "n", 3, None, None), ("u", "m", 4, [], {})], "entity_type string, normalized_value string, o int, tags array<string>, metadata map<string,string>")
    got = {r.entity_type: r for r in entities.deduplicate(e, F.col("o")).collect()}
    assert (got["t"].tags, got["t"].n_mentions, got["t"].metadata) == (["a", "b"], 3, {"k": "2", "z": "0"})
    assert (got["u"].tags, got["u"].n_mentions, got["u"].metadata) == ([], 1, {})


def test_strings_of_deep_records(spark):
    deep = '{"a":' * 3000 + '"x"' + "}" * 3000
    got = entities.walk_strings(spark.createDataFrame([(1, deep), (2, '{"l":["s",["no"],{"k":"v"}],"n":1}')], "i int, data string"), "data", "i").collect()
    assert sorted((r.i, r.text) for r in got) == [(1, "x"), (2, "s"), (2, "v")]


def test_streams_find_late_copies(spark):
    src, out, cp = scratch(spark, "src"), scratch(spark, "out"), scratch(spark, "cp")
    e = lambda *ids: spark.createDataFrame([(i, "entity.created", "events.entity.created", dt.datetime(2025, 1, 1), None, None, "{}", "{}") for i in ids], events.ENVELOPE)
    for ids in (("a", "b", "a", None), ("b", "c"), ("a", "c", None)):
        events.publish(e(*ids), src)
        events.once_stored(events.subscribe(spark, src), out, cp).awaitTermination()
    assert sorted(str(r[0]) for r in spark.read.parquet(out).select("event_id").collect()) == ["None", "None", "a", "b", "c"]


def test_late_rows_are_dropped_beyond_the_watermark(spark):
    src, out, cp = scratch(spark, "src"), scratch(spark, "out"), scratch(spark, "cp")
    t = dt.datetime(2025, 1, 1)
    put = lambda *hours: spark.createDataFrame([(t + dt.timedelta(hours=h),) for h in hours], "timestamp timestamp").write.mode("append").parquet(src)

    def run():
        s = spark.readStream.schema("timestamp timestamp").parquet(src)
        events.run_available(events.tumbling(s, "1 hour", "2 hours"), out, cp)

    for hours in ((0, 0, 1), (10,), (0, 9), (20,)):
        put(*hours)
        run()
    got = {r.start.hour: r.n for r in spark.read.schema("start timestamp, n bigint").parquet(out).collect()}
    assert got[0] == 2 and got[1] == 1 and got[9] == 1 and got[10] == 1  # the third row of hour 0 came too late


def test_polling_goes_on_after_an_error(spark):
    src, seen, waits = scratch(spark, "src"), [], []
    events.publish(spark.createDataFrame([("a", "x", "events.x", dt.datetime(2025, 1, 1), None, None, "{}", "{}")], events.ENVELOPE), src)

    def handle(batch, n):
        seen.append(n)
        if len(seen) == 1:
            raise OSError("the feed is down")

    failed = events.poll_patiently(lambda: events.subscribe(spark, src), handle, scratch(spark, "cp"), interval_s=5, back_off_s=1, polls=3, sleep=waits.append)
    assert failed == 1 and waits == [1, 5] and len(seen) == 2


def test_retention_by_bytes(spark):
    t = dt.datetime(2025, 1, 9)
    e = spark.createDataFrame([(i, t - dt.timedelta(days=i), "x" * 10) for i in range(10)] + [(90, t, None)], "event_id bigint, timestamp timestamp_ntz, payload string")
    keep = lambda **k: sorted(r.event_id for r in events.retained(e, F.lit(t), **k).collect())
    assert keep() == [0, 1, 2, 3, 4, 5, 6, 7, 90] and keep(max_bytes=25) == [0, 1, 90] and keep(max_messages=2) == [0, 90]


def test_stores_and_exports(spark, tmp_path):
    store = objects.ObjectStore(spark, f"file://{tmp_path}/o")
    store.ensure()
    store.put("raw", "k", b"1")
    with pytest.raises(ValueError):
        store.drop("raw")
    assert store.drop("audit") and store.buckets_there() == ["raw", "enriched", "reports"]
    df = spark.createDataFrame([("1", '{"a":\n 1}', None), ("2", "[2]", None), ("3", None, None)], "id string, data string, created_at timestamp")
    sinks.export(df, f"file://{tmp_path}/a.json", "json array")
    assert json.loads((tmp_path / "a.json").read_bytes()) == [{"a": 1}, [2]]
    sinks.export(df, f"file://{tmp_path}/lines", "json")
    good, bad = files.scan_json_lines(spark, f"file://{tmp_path}/lines")
    assert (good.count(), bad.count()) == (1, 1)


def test_connector_states_come_from_the_error(spark):
    class Busy(connectors.Connector):
        def fetch(self, spark, query=None):
            raise connectors.RateLimited("later")

    class Chatty(connectors.Connector):
        def fetch(self, spark, query=None):
            raise ValueError("rate limit is a word in this message")

    assert [r.status for r in connectors.fetch_all(spark, [Busy("a", ""), Chatty("b", "")])[1]] == ["rate_limited", "error"]


def test_schema_from_nothing(spark):
    s = spark.createDataFrame([], "id string, workspace_id string, name string, version int, status string, fields string")
    p = spark.createDataFrame([], schema.PROFILE)
    assert json.loads(schema.from_inferred(s, p, "w", "n").first().fields) == []


def test_upsert_with_relations_twice(spark):
    n = spark.createDataFrame([("n1", "City", "v", "v", "w")], "id string, label string, value string, normalized_value string, workspace_id string")
    e = spark.createDataFrame([], "src string, dst string, type string")
    new = spark.createDataFrame([("x", "org", " A ", "w"), ("y", None, None, "w")], "id string, entity_type string, value string, workspace_id string")
    rel = spark.createDataFrame([("x", "n1"), ("x", "n1"), ("y", "x"), ("z", "n1")], "src string, dst string")
    for _ in range(2):
        n, e, report = graph.upsert_with_relations(n, e, new, rel)
    assert n.count() == 3 and sorted(tuple(r) for r in e.collect()) == [("x", "n1", "RELATED_TO"), ("y", "x", "RELATED_TO")]
    assert {tuple(r) for r in report.collect()} == {("x", 1), ("y", 1)}
