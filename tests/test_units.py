"""Golden cases of parsers, expressions and small operators."""

import datetime as dt
import hashlib
import json
import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidewright.functions import entity as E
from tidewright.functions import jsontext as J
from tidewright.functions import web as W
from tidewright.operators import compliance, entities, graph, records, review, schema, sinks, vectors
from tidewright.sources import connectors, files
from tidewright.streaming import events


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_extraction(spark):
    text = "Mail Bob@ProtonMail.com, see https://www.web.com/a/ from 10.0.0.12; username: neo_1 @Amy"
    df = spark.createDataFrame([(text,), (None,), ("",), ("no entities here",)], "t string")
    got = {(r.entity_type, r.value, r.normalized_value) for r in entities.extract(df, "t").collect()}
    assert got == {
        ("email", "Bob@ProtonMail.com", "bob@protonmail.com"), ("phone", "10.0.0.12", "100012"), ("ip_address", "10.0.0.12", "10.0.0.12"), ("domain", "ProtonMail.com", "protonmail.com"), ("domain", "www.web.com", "eb.com"),
        ("url", "https://www.web.com/a/", "https://www.web.com/a"), ("social_handle", "@Amy", "amy"), ("social_handle", "@ProtonMail", "protonmail"), ("username", "neo_1", "neo_1"),
    }
    phones = spark.createDataFrame([("call +1 (555) 010-9999 on 2024-01-05",)], "t string").select(E.matches(F.col("t"), "phone")).first()[0]
    assert phones == ["+1 (555) 010-9999", "2024-01-05"]


def test_normal_forms_and_threat(spark):
    n = lambda t, v, **k: one(spark, E.normalize(F.lit(t), F.lit(v), **k))[0]
    assert [n("domain", v) for v in ("www.web.com", "web.com", "wwf.org")] == ["eb.com", "eb.com", "f.org"] and n("domain", "www.web.com", strict_www=True) == "web.com"
    assert n("phone", "+1 (555) 010-9999") == "+15550109999" and n("other", " x　") == "x"
    th = lambda t, v, tags=None: one(spark, E.threat(F.lit(t), F.lit(v), F.array(*map(F.lit, tags)) if tags is not None else None))[0]
    assert [th("ip_address", "8.8.10.1"), th("domain", "a.onion"), th("email", "a@mail.ru"), th("url", "x")] == ["high", "critical", "medium", "info"]
    assert [th("url", "x", t) for t in (["monitor"], ["adaptive"], ["SPAM"], [])] == ["high", "critical", "low", "info"]
    assert one(spark, *[E.is_private_ip(F.lit(x)) for x in ("10.1.1.1", "172.20.0.1", "172.32.0.1", "127.9.9.9", "1.2.3", "x.1.1.1")]) == (True, True, False, True, False, False)
    assert one(spark, E.enrichment(F.lit("domain"), F.lit("eb.com"))["domain_hash"])[0] == "5ba87ca5b636ba28"


def test_record_walk(spark):
    df = spark.createDataFrame([('{"a":{"b":["x@y.com",{"c":"z@y.com"}]},"n":5,"l":[["q@y.com"]]}',), (None,), ("{cut",)], "d string")
    got = entities.walk_strings(df.withColumn("k", F.lit(1)), "d", "k", label="f:")
    assert {(r.path, r.text) for r in got.collect()} == {("f:a.b[0]", "x@y.com"), ("f:a.b[1].c", "z@y.com")}


def test_merge_and_upsert(spark):
    t = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    cols = "workspace_id string, entity_type string, normalized_value string, value string, source string, confidence double, threat_level string, tags array<string>, metadata map<string,string>, first_seen timestamp_ntz, last_seen timestamp_ntz"
    rows = [("w", "url", "x", "X", "s1", 0.5, None, ["b", "a"], {"k": "1", "p": "q"}, t[0], t[0]), ("w", "url", "x", "x", "s2", 0.9, None, None, {"k": "2"}, t[1], t[2])]
    d = entities.deduplicate(spark.createDataFrame(rows, cols), F.col("first_seen"), ("workspace_id", "entity_type", "normalized_value")).first()
    assert (d.value, d.source, d.confidence, d.tags, d.metadata, d.last_seen, d.n_mentions) == ("X", "s1", 0.9, ["a", "b"], {"k": "2", "p": "q"}, t[2], 2)
    a = spark.createDataFrame(rows[:1], cols)
    b = spark.createDataFrame([rows[1][:5] + (0.1, "high") + rows[1][7:], ("w", "url", "y", "Y", "s3", 1.0, None, None, None, t[1], t[1])], cols)
    u = {r.normalized_value: r for r in entities.upsert(a, b).collect()}
    assert (u["x"].value, u["x"].confidence, u["x"].threat_level, u["x"].metadata["k"], u["x"].first_seen, u["x"].last_seen) == ("X", 0.5, "high", "2", t[0], t[2]) and u["y"].value == "Y"


def test_filters(spark):
    df = spark.createDataFrame([(1, '{"k":9}'), (2, '{"k":10}'), (3, '{"k":"abc"}'), (4, "{}"), (5, '{"k":true}'), (6, None), (7, '{"k":{"a":[1,{"b":2}],"c":"x"}}'), (8, '{"k":[1,2,"x"]}')], "id int, data string")
    q = lambda f, mode="text": [r.id for r in df.where(records.compile_filter(records.parsed("data"), f, mode)).orderBy("id").collect()]
    assert q({"k": 9}) == [1] and q({"k": [9, 10]}) == [1, 2] and q({"k": []}) == [] and q({"k": True}) == [5]
    assert q({"k": {"$gt": 9}})[:2] == [3, 5] and q({"k": {"$gt": 9}}, "typed") == [2]
    assert 1 not in q({"k": {"$ne": 9}}) and 4 not in q({"k": {"$ne": 9}}) and 3 in q({"k": {"$like": "B"}})
    assert q({"k": {"$contains": {"a": [{"b": 2}]}}}) == [7] and q({"k": {"$contains": [2, "x"]}}) == [8] and q({"k": {"$contains": 1}}) == [8] and q({"k": {"$contains": {"a": 1}}}) == [7] and q({"k": {"$contains": {"c": "y"}}}) == []
    assert q({"k": None}) == [4, 6]
    for bad in ({"k": {"$what": 1}},):
        with pytest.raises(ValueError):
            q(bad)
    with pytest.raises(ValueError):
        records.query(df, {}, limit=1001)


def test_updates_and_deletes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    ch = spark.createDataFrame([(1, None), (9, "z")], "id int, v string")
    assert sorted(map(tuple, records.update(df, ch).collect())) == [(1, None, "x"), (2, "b", "y")]
    assert sorted(map(tuple, records.patch(df, ch).collect())) == [(1, "a", "x"), (2, "b", "y")]
    assert [r.id for r in records.delete(df, ch).collect()] == [2]


def test_headers_and_values():
    assert [files.clean_header(h) for h in (" First  Name ", "e-mail/addr.", "'Amount ($)'", "###", "größe", None)] == ["First_Name", "e_mail_addr", "Amount", "unnamed", "größe", "unnamed"]
    assert [files.convert_value(v) for v in ("", "yes", "No", "1", "1_000", "1.5", "nan", " x ", "  ")] == [None, True, False, 1, 1000, 1.5, "nan", "x", ""]
    assert files.sniff_delimiter("a;b\n1;2\n") == ";" and files.detect_format("A.JSONL") == "json"
    for bad in ("a.xls", "a.txt", "a"):
        with pytest.raises(ValueError):
            files.detect_format(bad)


def _parse(f, content, **k):
    got = list(f(content, **k))
    return [(r["row_number"], json.loads(r["data"])) for r in got if r["data"]], [(r["row_number"], r["severity"]) for r in got if r["message"]]


def test_readers():
    assert _parse(files.parse_csv, b"a;b\n1;2\n3;4\n") == ([(2, {"a": 1, "b": 2}), (3, {"a": 3, "b": 4})], [])
    assert _parse(files.parse_csv, b"x,y\n1\n1,2,3\nyes,\n") == ([(2, {"x": 1, "y": None}), (3, {"x": 1, "y": 2}), (4, {"x": True, "y": None})], [(3, "warning")])
    assert _parse(files.parse_csv, b"a,a\n1,2\n")[0] == [(2, {"a": 2})] and _parse(files.parse_csv, "n,m\n\xe9,1\n".encode("latin-1"))[0][0][1]["n"] == "é"
    assert _parse(files.parse_csv, b"a,b\n\n1,2\n")[0][0] == (2, {"a": None, "b": None}) and _parse(files.parse_csv, b"") == ([], [])
    assert _parse(files.parse_json, b'[{"a":1},{"b":2},5]') == ([(1, {"a": 1}), (2, {"b": 2})], [(3, "error")])
    assert _parse(files.parse_json, b'{"a":1}\n\n{"a":\n{"a":2}\n') == ([(1, {"a": 1}), (4, {"a": 2})], [(3, "error")])
    assert _parse(files.parse_json, b"5") == ([], [(None, "error")])
    book = files.write_xlsx(["a", "b c"], [["1", None], ["", ""], ["<x>", "y\x01"]])
    assert _parse(files.parse_xlsx, book) == ([(2, {"a": "1", "b_c": None}), (4, {"a": "<x>", "b_c": "y"})], []) and files.sheet_names(book) == ["Data"]
    assert _parse(files.parse_xlsx, b"junk")[1] == [(None, "error")] and _parse(files.parse_xlsx, book, sheet="no")[1] == [(None, "error")]


def test_upload_gate(spark, tmp_path):
    for name, content in {"a.json": b'[{"a":1},5]', "b.csv": b"x\n1,2\n"}.items():
        (tmp_path / name).write_bytes(content)
    parsed = files.parse_files(spark, str(tmp_path))
    rec, err, jobs = files.split_parsed(parsed)
    assert {r.file.rsplit("/", 1)[1]: r.state for r in jobs.collect()} == {"a.json": "failed", "b.csv": "complete"} and rec.count() == 1 and err.count() == 2
    assert files.split_parsed(parsed, "quarantine")[0].count() == 2


def _infer(spark, values, kind="text"):
    if kind == "text":
        cells = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values, 1)], "ord int, name string, value string")
    else:
        cells = spark.createDataFrame([(i, "f", json.dumps(v)) for i, v in enumerate(values, 1)], "ord int, name string, v string").select("ord", "name", F.try_parse_json("v").alias("value"))
    r = schema.infer(cells, kind).first()
    return r.inferred_type, r.confidence, r.nullable


def test_inference(spark):
    assert _infer(spark, [1, 2, None], "json") == ("int", 1.0, True) and _infer(spark, ["1", "0", "yes"]) == ("bool", 1.0, False)
    assert _infer(spark, [1, "x"], "json") == ("int", 0.5, False) and _infer(spark, ["2024-01-05", "05-01-2024", "01/05/2024"]) == ("datetime", 1.0, False)
    assert _infer(spark, [None, ""]) == ("str", 1.0, True) and _infer(spark, [None, None]) == ("str", 0.5, True) and _infer(spark, [{"a": 1}, [1]], "json")[:2] == ("str", 1.0)
    assert _infer(spark, ["Total", "2024-01-05"], "excel") == ("datetime", 1.0, False) and _infer(spark, ["1e5", "nan", "x"])[:2] == ("float", 2 / 3)


def test_validation(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":null,"z":1}',), ("{}",), (None,)], "d string")
    got = [r[0] for r in df.select(schema.validate(F.col("d"), [("a", False), ("b", True)])).collect()]
    assert got == [[], ["Field 'a' cannot be null"], ["Missing required field: a"], ["Missing required field: a"]]


def test_embedding(spark):
    def model(text):
        raw = [b / 127.5 - 1 for i in range(12) for b in hashlib.sha256(f"{text.lower()}{i}".encode()).digest()][:384]
        n = math.sqrt(sum(x * x for x in raw))
        return [x / n for x in raw]

    v, w = one(spark, vectors.hash_embedding(F.lit("email bob@example.com")), vectors.hash_embedding(F.lit("EMAIL BOB@example.com")))
    assert v == w and len(v) == 384 and max(abs(a - b) for a, b in zip(v, model("email bob@example.com"))) < 1e-12
    assert [round(x, 6) for x in v[:4]] == [-0.014509, 0.045649, -0.001769, 0.044233]
    ids = ["ent-1", "x", "é"]
    got = one(spark, *[vectors.point_id(F.lit(i)) for i in ids])
    assert got[0] == 2918077806081566967 and list(got) == [uuid.uuid5(uuid.NAMESPACE_DNS, i).int % 2**63 for i in ids]


def test_vector_search(spark):
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(50)] + [(90, None), (91, []), (92, [0.0, 0.0, 0.0]), (93, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = {}
    for r in vectors.search(df, df.where("vec_id < 3"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    full = [(i, v) for i, v in rows if v and len(v) == 3 and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for q in range(3):
        want = sorted(full, key=lambda t: (-round(cos(rows[q][1], t[1]), 12), t[0]))[:4]
        assert [i for _, i in sorted(got[q])] == [i for i, _ in want]
    assert vectors.search(df, df.where("vec_id < 0"), 4).count() == 0


def test_graph_paths(spark):
    e = spark.createDataFrame([("a", "b", "T"), ("b", "c", "T"), ("c", "a", "T")], "src string, dst string, type string")
    got = sorted((r.depth, r.node_id) for r in graph.neighbors(e, "a", 3).collect())
    assert got == [(1, "b"), (1, "c"), (2, "b"), (2, "c"), (3, "a"), (3, "a")]
    with pytest.raises(ValueError):
        graph.neighbors(e, "a", 4)
    for sql in ("DELETE FROM nodes", "SELECT 1; DROP TABLE x", "drop view nodes"):
        with pytest.raises(ValueError):
            graph.run_sql(e, e, sql)


def test_lineage_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", None)], "record_id string, parent_record_id string")
    got = {(r.record_id, r.ancestor_id, r.depth) for r in compliance.ancestors(df).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2)}


def test_review(spark):
    p = [one(spark, review.priority(F.lit(x)))[0] for x in (0.29, 0.3, 0.49, 0.5, 0.69, 0.7)]
    assert p == ["critical", "high", "high", "medium", "medium", "low"]
    w = lambda a, b: one(spark, review.weighted_confidence(F.lit(a), F.lit(b) if b is not None else None))[0]
    assert [w([0.5, 1.0], [1.0, 3.0]), w([0.5, 1.0], [1.0]), w([0.5], [0.0]), w([0.5, 1.0], None)] == [0.875, 0.75, 0.0, 0.75]


def test_checksums(spark):
    t = '{"b": 1, "a": "é"}'
    got = spark.createDataFrame([(t,)], "t string").select(compliance.json_checksum("t")).first()[0]
    assert got == hashlib.sha256(json.dumps(json.loads(t), sort_keys=True).encode()).hexdigest()
    log = spark.createDataFrame([(1, "x", None), (2, None, "x")], "id int, a string, b string")
    c = [r.checksum for r in compliance.log_action(log, ["a", "b"]).collect()]
    assert c[0] != c[1] and compliance.verify(compliance.log_action(log, ["a", "b"]).withColumn("a", F.lit("y")), ["a", "b"]).where("valid").count() == 0


def test_requests(spark):
    r = lambda p: one(spark, W.resource(F.lit(p)))[0]
    assert tuple(r("/api/graph/12")) == ("graph", "12") and tuple(r("/x/_y")) == ("x", None) and r("/").resource_id is None
    assert one(spark, W.normalize_path(F.lit("/a/123/7f3c2a10-0000-4000-8000-000000000000/b")))[0] == "/a/{id}/{id}/b"
    assert one(spark, W.is_domain(F.lit("a-b.example")), W.is_domain(F.lit("1.2.3.4")), W.is_ip(F.lit("1.2.3.4"))) == (True, False, True)
    assert one(spark, W.file_size(F.lit(0)), W.file_size(F.lit(1536)), W.file_size(F.lit(1048576))) == ("0 Bytes", "1.5 KB", "1 MB")


def test_subjects(spark):
    m = lambda p, s: one(spark, events.subject_matches(F.lit(s), p))[0]
    assert m("events.entity.*", "events.entity.created") and not m("events.entity.*", "events.ingestion.failed") and m("events.>", "events.a.b") and not m("events.*", "events.a.b")
    with pytest.raises(ValueError):
        events.event("entity.deleted", F.lit("1"), F.current_timestamp(), F.lit("s"), nope=F.lit(1))


def test_stream_replay(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    make = lambda ids: spark.createDataFrame([(i, dt.datetime(2025, 1, 1, 0, 0, n)) for n, i in enumerate(ids)], "i string, t timestamp_ntz").select(*events.event("entity.created", F.col("i"), F.col("t"), F.lit("s"), entity_id=F.col("i")))
    for ids in ("ab", "bca", "d"):
        events.publish(make(ids), src)
        events.run_available(events.once(events.subscribe(spark, src)).select("event_id"), out, cp)
    assert sorted(r[0] for r in spark.read.schema("event_id string").parquet(out).collect()) == list("abcd")


def test_stream_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for n, mins in enumerate([(0, 1, 30), (29, 2, 95), (3, 200)]):
        spark.createDataFrame([(dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m),) for m in mins], "timestamp timestamp").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("timestamp timestamp").parquet(src)
        events.run_available(events.tumbling(s, "10 minutes", "20 minutes"), out, cp)
    got = {r.start.minute + 60 * r.start.hour: r.n for r in spark.read.parquet(out).collect()}
    assert got[0] == 2 and got[30] == 1 and got[20] == 1  # minute 2 came too late, minute 29 in time


def test_fan_out(spark, tmp_path):
    src = str(tmp_path / "src")
    events.publish(spark.range(3).select(*events.event("entity.deleted", F.col("id").cast("string"), F.lit(dt.datetime(2025, 1, 1)), F.lit("s"))), src)
    got = []
    hooks = events.fan_out(events.subscribe(spark, src), {"e": ("events.entity.*", lambda b, i: got.append(b.count())), "c": ("events.connector.*", lambda b, i: got.append(-b.count()))}, str(tmp_path / "cp"))
    for q in hooks.values():
        q.awaitTermination()
    assert sum(got) == 3


def test_captured_source(spark, tmp_path):
    (tmp_path / "feed.json").write_text('[{"a":1},{"a":2}]')
    spark.dataSource.register(connectors.CapturedFeed)
    assert [json.loads(r.data)["a"] for r in spark.read.format("captured").load(str(tmp_path / "feed.json")).orderBy("data").collect()] == [1, 2]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("1", '{"b":1,"a":"x,\\"y"}'), ("2", '{"c":true}'), ("3", None)], "id string, data string")
    sinks.export(df, str(tmp_path / "o.csv"), "csv")
    got = sorted(map(tuple, spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "o.csv")).collect()), key=str)
    assert ('x,"y', "1", None) in got and (None, None, "true") in got
    sinks.export(df, str(tmp_path / "o.xlsx"), "excel")
    assert [r["data"] for r in files.parse_xlsx((tmp_path / "o.xlsx").read_bytes())]
    assert sinks.auto_schema_name("w/job/feed.csv", "12345678-9") == "auto_feed_12345678"


def test_json_text():
    assert J.dump(J.read('{"a":1.50,"b":[null,true,"x"],"c":"é"}')) == '{"a":1.50,"b":[null,true,"x"],"c":"é"}'
    assert J.read('"{\\"a\\":1}"') == {"a": "1"} and J.read("{") is None and J.read(None) is None and J.read("[" * 5000) is None


def test_shortcuts_find_what_the_plain_patterns_find(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.@-_%x9:/ user") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 70 + ".com " + "-" * 66 + "b.com a@b.com.d@e.fr", "user" * 40, "http://a b https://x", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, p in E.PATTERNS.items():
        plain = F.array_distinct(F.regexp_extract_all("t", F.lit("(?iU)" + p), 1 if name == "username" else 0))
        assert d.where(~plain.eqNullSafe(E.matches(F.col("t"), name))).count() == 0


def test_hot_keys(spark, monkeypatch):
    from tidewright.operators import skew

    df = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 40}" if i % 4 else None) for i in range(400)], "i int, key string")
    assert skew.hot_keys(df, "key", 400) is None
    monkeypatch.setattr(skew, "LEAST", 50)
    monkeypatch.setattr(skew, "HOT", 4)
    assert sorted(str(r[0]) for r in skew.hot_keys(df, "key", 400).collect()) == ["None", "hot"]


def test_no_import_of_the_text_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "tidewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
