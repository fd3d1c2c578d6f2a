"""Messages, changes, nested records: brute force and edge cases."""

import json
import random
import uuid

from pyspark.sql import functions as F

from tidewright.functions import jsontext as J
from tidewright.operators import changes, messages, nested
from tidewright.session import table

IDS = "delivery_id bigint, event_id string"


def _spell(u, rng):
    u = rng.choice([u, u.upper(), u.replace("-", ""), "{" + u + "}", f" {u}\t", "urn:uuid:" + u, "URN:UUID:" + u.upper(), f'"{u}"'])
    return u


def test_messages_spellings_and_hot_key(spark, rows):
    rng = random.Random(3)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(60)]
    data, want = [], set()
    first = {}
    for n in range(1, 1200):
        u = ids[0] if rng.random() < 0.4 else rng.choice(ids)  # one id holds a third of all rows
        data.append((n, _spell(u, rng)))
        if u in first:
            want.add((first[u], n))
        first.setdefault(u, n)
    data += [(5000, None), (5001, ""), (5002, "  "), (5003, "not a uuid"), (5004, " not a uuid "), (5005, "Not a uuid"), (None, ids[0])]
    want.add((5003, 5004))
    df = spark.createDataFrame(data, IDS).repartition(7).withColumns({"k": F.lit(1), "o": F.lit("x"), "b": F.lit(2)})
    got = rows(messages.message_copies(df))
    assert set(got) == want and len(got) == len(want)


def test_messages_upserts_are_idempotent(spark):
    a = spark.createDataFrame([(1, "a" * 32), (3, "b" * 32)], IDS)
    b = spark.createDataFrame([(2, "A" * 32), (1, "a" * 32), (4, "c" * 32)], IDS)
    store = messages.MessageStore(spark, buckets=4)
    store.upsert(b, "b").upsert(a, "a").upsert(b, "b")
    assert {tuple(r) for r in store.copies().collect()} == {(1, 2)}
    assert messages.deduplicate(a.union(b.where("delivery_id = 2"))).count() == 2


def test_messages_empty(spark):
    assert messages.message_copies(spark.createDataFrame([], IDS)).count() == 0
    assert messages.message_copies(spark.createDataFrame([(1, None), (2, " ")], IDS)).count() == 0


FEED = "feed_seq bigint, event_id string, event_type string, timestamp timestamp_ntz, entity_id string, entity_data string, changes string"


def _feed(rng, n):
    import datetime as dt

    out = []
    for i in range(1, n + 1):
        e = "hot" if rng.random() < 0.4 else f"e{rng.randrange(12)}"
        ts = dt.datetime(2025, 1, 1) + dt.timedelta(seconds=rng.randrange(n // 2))
        kind = rng.choice(["created", "updated", "updated", "updated", "deleted"])
        val = lambda: rng.choice([None, 1, 0.50, "x", True, {"a": 1}, "{}"])
        data = json.dumps({f: val() for f in rng.sample("pqrs", 2)})
        ch = rng.choice([None, "{}", "{bad", json.dumps({f: rng.choice([val(), {"old": 1, "new": val()}]) for f in rng.sample("pqrs", 2)})])
        out.append((i, f"ev{i}", f"entity.{kind}", ts, e, data if kind == "created" else None, ch if kind == "updated" else None))
    for _ in range(n // 5):  # deliveries that come again, later
        r = rng.choice(out)
        out.append((len(out) + 1, *r[1:]))
    rng.shuffle(out)
    return out


def _brute(feed):
    ev = {}
    for r in feed:
        if r[1] not in ev or r[0] < ev[r[1]][0]:
            ev[r[1]] = r
    st = {}
    for r in sorted(ev.values(), key=lambda r: (r[3], r[0])):
        kind, e = r[2].split(".")[1], r[4]
        if kind == "created":
            st[e] = {k: J.scalar(v) for k, v in J.read(r[5]).items() if v is not None}
        elif kind == "deleted":
            st.pop(e, None)
        elif e in st and isinstance(J.read(r[6]), dict):
            for k, v in J.read(r[6]).items():
                if isinstance(v, dict) and "new" in v and "old" in v:
                    v = v["new"]
                st[e].pop(k, None)
                if v is not None:
                    st[e][k] = J.scalar(v)
    return {(e, k, v) for e, f in st.items() for k, v in f.items()}


def test_changes_against_a_fold(spark):
    feed = _feed(random.Random(11), 500)
    df = spark.createDataFrame(feed, FEED).withColumn("bucket", F.lit("clash"))
    want = _brute(feed)
    assert {tuple(r) for r in changes.current_state(df).collect()} == want
    t = changes.CowTable(spark, buckets=8)
    for part in (feed[:200], feed[200:350], feed[150:], feed[:50]):
        t.apply(spark.createDataFrame(part, FEED))
    assert {tuple(r) for r in t.state().collect()} == want and t.version() == 4
    t.vacuum()
    assert {tuple(r) for r in t.state().collect()} == want and t.version() == 4 and "manifest-3.json" not in t.files.names(t.path)
    try:
        t.files.commit(f"{t.path}/manifest-4.json", "{}")
    except RuntimeError:
        assert t.manifest() and not any(n.endswith(".tmp") for n in t.files.names(t.path))
    else:
        raise AssertionError("a committed manifest was replaced")
    assert {tuple(r) for r in changes.current_state(df, loads=3).collect()} == want


def test_changes_edges(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    feed = [
        (1, "a", "entity.updated", t, "e", None, '{"p":1}'),  # before it exists
        (2, "b", "entity.created", t, "e", '{"p":0.50,"q":null,"r":"é"}', None),  # equal times: lower feed_seq first
        (3, None, "entity.updated", t, "e", None, '{"p":null}'),
        (4, "", "entity.updated", t, "e", None, None),
        (5, "c", "entity.created", None, "f", '{"p":1}', None),
        (6, "d", "entity.created", t, None, '{"p":1}', None),
        (7, "x", "other", t, "g", None, None),
        (8, "y", "entity.created", t, "g", "broken", None),
    ]
    assert {tuple(r) for r in changes.current_state(spark.createDataFrame(feed, FEED)).collect()} == {("e", "r", "é")}
    assert changes.current_state(spark.createDataFrame([], FEED)).count() == 0


def test_nested_paths(spark, rows):
    doc = {"x": {"services": [{"port": 1, "vulns": [{"id": 1}, None, {"id": 2}]}, None, 7], "MX": {"lat": "z"}}, "commercial_vessels": {"lat": 1.50, "waypoints": [{"lat": None}, {"lat": -0.0}], "inner": {"legs": [{"waypoints": {"lat": 5}}]}}, "lat": 3}
    text = json.dumps(doc).replace("1.5", "1.50")
    data = [("a", text), ("b", json.dumps(text)), ("c", text[:-9]), ("d", None), ("e", "[]"), ("f", ""), ("g", "5"), ("h", '[{"legs":[{"lat":"q"}]}]')]
    got = rows(nested.occurrences(spark.createDataFrame(data, "id string, data string").withColumn("record_id", F.lit(1))).select("record_id", "parent_path", "child_path", "lat"))
    want = [
        ("", "commercial_vessels", "1.50"),
        ("", "x.MX", "z"),
        ("", "x.services[0]", ""),
        ("commercial_vessels", "commercial_vessels.inner.legs[0]", ""),
        ("commercial_vessels", "commercial_vessels.waypoints[0]", ""),
        ("commercial_vessels", "commercial_vessels.waypoints[1]", "-0.0"),
        ("commercial_vessels.inner.legs[0]", "commercial_vessels.inner.legs[0].waypoints", "5"),
        ("x.services[0]", "x.services[0].vulns[0]", ""),
        ("x.services[0]", "x.services[0].vulns[2]", ""),
    ]
    assert got == sorted([(r, *w) for r in "ab" for w in want] + [("h", "", "[0].legs[0]", "q")], key=str)


def test_nested_identities(spark):
    data = [("a", '{"legs":[{"b":1,"a":"1"},{"a":"1","b":1},{"a":1,"b":1}]}'), ("b", '{"legs":{"a":"1","b":1}}')]
    df = spark.createDataFrame(data, "id string, data string")
    ids = nested.occurrences(df, promote=()).groupBy("object_id").count().collect()
    assert sorted(r[1] for r in ids) == [1, 3]
    assert sorted(r.n for r in nested.objects(df, keys=("legs",)).collect()) == [1, 3]
    empty = spark.createDataFrame([], "id string, data string")
    assert nested.occurrences(empty).count() == 0 and nested.objects(empty).count() == 0


def test_nested_records_can_be_rebuilt(spark):
    """Bridge and store give back every record, those of a real table among them."""
    data = [("a", '{"x":[1.50,[{"y":[]},[null,true]],"s"],"owner":{"n":{"#":"q"}},"legs":[{"t":[1,2]},null,{"t":[1,2]}]}'), ("b", '[{"a":{}},[[]],3]'), ("c", "{}"), ("d", '{"k":"\\ud800"}')]
    df = spark.createDataFrame(data, "id string, data string").unionByName(table(spark, "/root/testdata/sf0.001", "data_records").select("id", "data"))
    bodies = {r.object_id: r.body for r in nested.objects(df).collect()}
    bridge = nested.occurrences(df, keys=None, promote=()).collect()
    root = {r.record_id: r.object_id for r in bridge if r.child_path == ""}
    want = {r.id: v for r in df.collect() if isinstance(v := J.read(r.data), (dict, list)) and r.id != "d"}
    assert len(want) > 100 and {k: nested.rebuild(root[k], bodies.get) for k in want} == want
    assert {r.object_id for r in bridge} == set(bodies) and "d" in root
    by_path = {(r.record_id, r.child_path): r for r in bridge}
    assert all(r.child_path == "" or by_path[r.record_id, r.parent_path].object_id == r.parent_id for r in bridge)


def test_nested_deep(spark):
    """As deep as the parser goes, through no recursion of our own."""
    deep = '{"legs":' * 2500 + "1" + "}" * 2500
    df = spark.createDataFrame([("a", deep), ("b", '{"legs":{}}')], "id string, data string")
    assert nested.occurrences(df).count() == (2500 if J.read(deep) is not None else 1)
    assert nested.objects(df).count() == (2502 if J.read(deep) is not None else 2)
