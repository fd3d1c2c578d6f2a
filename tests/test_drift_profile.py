"""Schema drift and data quality: scripts, loads, findings, edge cases."""

import itertools
import json
import random

from tidewright.functions import jsontext as J
from tidewright.operators import drift, profile
from tidewright.operators.drift import Node, assign, edit_script, meaning_cost, parse_fields, words_of
from tidewright.operators.fieldstats import bin_of, describe, form_of


def test_assignment_is_optimal():
    rng = random.Random(5)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            c = [[rng.randrange(20) for _ in range(n)] for _ in range(n)]
            best = min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = assign(c)
            assert sorted(got) == list(range(n)) and sum(c[i][got[i]] for i in range(n)) == best


def _n(name, kind="str", text="", children=()):
    return Node(name, kind, words_of(text), list(children))


def test_script():
    old = [_n("id", "str", "Number of the case"), _n("score", "int", "Risk points"), _n("ip", "str", "Address"), _n("asn", "str", "Network")]
    new = [_n("score", "str", " RISK POINTS."), _n("caseNo", "str", "number of THE case."), _n("host_asn", "str", "Second network"), _n("ip", "str", "other words")]
    d, s = edit_script(old, new, meaning_cost)
    assert sorted(s) == [("added", "host_asn", ""), ("removed", "asn", ""), ("renamed", "id", "caseNo"), ("retyped", "score", "")] and d > 0
    assert edit_script(old, list(reversed(old)), meaning_cost) == (0.0, [])


def test_nested_script_and_projection():
    old = [_n("a", "json", "", [_n("x", "int", "Left edge"), _n("k", "str", "Key")]), _n("b", "json", "", [_n("y", "int", "Up")])]
    new = [_n("a", "json", "", [_n("x2", "int", "left edge")]), _n("b", "json", "", [_n("y", "int", "Up"), _n("k", "str", "Key")])]
    s = edit_script(old, new, meaning_cost)[1]
    assert ("renamed", "a.x", "x2") in s and ("moved", "a.k", "b.k") in s and len(s) == 2
    p = drift.compile_script([*s, ("retyped", "n", ""), ("renamed", "old", "new"), ("added", "z", "")], {"n": "int"})
    assert p.read({"a": {"x2": 1}, "b": {"y": 2, "k": "v"}, "n": "07", "new": 3, "z": 4}) == {"a": {"x": 1, "k": "v"}, "b": {"y": 2}, "n": "07", "old": 3, "z": 4}
    assert p.read({"a": 5, "b": None, "n": [1]}) == {"a": 5, "b": None, "n": [1]} and p.read({}) == {}


def test_swapped_names_are_found():
    old = [_n("from_port", "str", "Harbour of departure"), _n("to_port", "str", "Next call")]
    new = [_n("from_port", "str", "next call"), _n("to_port", "str", "harbour of departure")]
    assert sorted(edit_script(old, new, meaning_cost)[1]) == [("renamed", "from_port", "to_port"), ("renamed", "to_port", "from_port")]


def test_scripts_are_cheapest():
    """Against all ways to match the fields."""
    rng = random.Random(7)
    texts = ["Case number", "Risk points", "Network owner", "Harbour call", ""]
    for _ in range(60):
        old, new = ([_n(n, rng.choice(["str", "int"]), rng.choice(texts)) for n in rng.sample("abcdef", rng.randrange(5))] for _ in "xy")
        pair = lambda a, b: drift._same_name(a, b) if a.name == b.name else meaning_cost(a, b)
        best = min(sum(c if (c := pair(a, new[j])) < 2 else 2 for a, j in zip(old, p) if j < len(new)) + sum(j >= len(new) for j in p) + len(set(range(len(new))) - set(p)) for p in itertools.permutations(range(len(new) + len(old)), len(old)))
        assert abs(edit_script(old, new, meaning_cost)[0] - best) < 1e-9


def test_casts():
    n = J.Num
    assert [drift.cast(v, k) for v, k in [("5", "int"), (n("5"), "str"), ("yes", "bool"), ("maybe", "bool"), (n("1735689600"), "datetime"), ({"value": "u"}, "str"), ("x", "int"), (None, "int")]] == ["5", "5", True, "maybe", "2025-01-01T00:00:00Z", "u", "x", None]


def test_parse_fields():
    assert [n.name for n in parse_fields('[{"name":"a","field_type":"int"},{"field_type":"x"},3]')] == ["a"]
    assert [n.kind for n in parse_fields('{"a":{"field_type":"int"},"b":5}')] == ["int"]
    assert parse_fields("nope") is None and parse_fields(None) is None and parse_fields("[]") == []


S = "id string, workspace_id string, name string, version int, fields string"


def _f(*specs):
    return json.dumps([{"name": n, "field_type": t, "description": d} for n, t, d in specs])


def test_versions(spark, rows):
    a = _f(("id", "str", "Case"), ("n", "int", "Points"))
    data = [("s1", "w", "x", 1, a), ("s3", "w", "x", 4, _f(("case", "str", "case."), ("n", "int", "Points"), ("z", "str", "New"))), ("s2", "v", "x", 2, _f(("q", "str", "Q"))), ("s4", "w", "x", 5, "broken"), ("s5", "w", "x", 6, None)]
    got = rows(drift.version_changes(spark.createDataFrame(data, S)))
    assert got == [("s3", "added", "z", ""), ("s3", "renamed", "id", "case")]
    assert drift.version_changes(spark.createDataFrame([], S)).count() == 0


R = "id string, job string, schema_id string, data string"


def test_loads(spark, rows):
    schemas = [("s", "w", "x", 1, _f(("code", "str", "Case number"), ("n", "int", "Points"), ("when", "datetime", "Time"), ("j", "json", "Any"))), ("bad", "w", "y", 1, "oops")]
    recs = []
    for i in range(60):
        recs.append((f"a{i}", "good", "s", json.dumps({"code": f"AB-{1000 + i}", "n": i, "when": "2025-01-01T00:00:00Z", "j": {"q": 1}})))
        recs.append((f"b{i}", "drifted", "s", json.dumps({"codeRef": f"AB-{2000 + i}", "n": str(i), "extra": f"https://x.test/{i}", "j": [1]})))
    recs += [("c", "good", "s", "{cut"), ("d", "good", "s", None), ("e", "lost", "none", "{}"), ("f", "lost", "bad", "{}"), ("g", None, "s", "{}"), ("h", "unread", "s", "[1]")]
    df = spark.createDataFrame(recs, R)
    got = rows(drift.load_changes(df, spark.createDataFrame(schemas, S)))
    assert got == sorted([("drifted", "renamed", "code", "codeRef"), ("drifted", "retyped", "n", ""), ("drifted", "added", "extra", ""), ("drifted", "removed", "when", "")], key=str)
    u = {r.record_id: r.fields for r in drift.unified(df.where("job is not null"), spark.createDataFrame(schemas, S)).collect()}
    assert u["b1"]["code"] == "AB-2001" and u["a1"]["code"] == "AB-1001" and "c" not in u
    assert drift.load_changes(spark.createDataFrame([], R), spark.createDataFrame(schemas, S)).count() == 0
    assert drift.load_changes(spark.createDataFrame([], R), spark.createDataFrame([], S)).count() == 0


def test_forms():
    assert form_of("2025-01-05T10:00:00Z")[0] == "T" and form_of("2025-13-05T10:00:00Z")[0] == "T?"
    assert form_of("10.0.0.1")[0] == "I" and form_of("10.999.0.1")[0] == "I?"
    assert form_of("AB-12")[0] != form_of("ab-12")[0] and form_of("AB-12")[0] == form_of("CD-123")[0] and form_of("AB-12")[1] != form_of("CD-123")[1]
    assert form_of("") [0] == "s" and bin_of(0) == "0" and float(bin_of(-1e300)) < 0
    long = "x y-" * 50_000
    assert form_of(long)[0] == form_of(long)[0] and form_of(long + "9")[0] != form_of(long + "z")[0] and form_of(long + "9")[1] != form_of(long + "99")[1]
    assert describe({f"k{i}": 1 for i in range(50)}) != describe({f"k{i}": 1 for i in range(51)})


P = "scope string, job string, id string, data string"


def test_violations(spark, rows):
    rng = random.Random(2)
    data = []
    for j in range(8):
        for i in range(40):
            d = {"code": f"AB-{rng.randrange(1000, 9999)}", "n": rng.randrange(10, 90), "s": rng.choice(["open", "shut", "held"]), "t": f"2025-{rng.randrange(1, 13):02}-11T00:00:00Z", "z": None if rng.random() < 0.05 else f"u{i}@x.test"}
            if j == 7:
                d["n"] = str(d["n"])  # shared by the whole load: a change of layout, no finding
                d["s"] = "held"
                if i % 10:
                    d["z"] = None
            data.append(["f", f"j{j}", f"{j}-{i}", d])
    for k, (f, v) in enumerate([("code", "AB 1234"), ("n", 999999), ("n", -4), ("n", "n/a"), ("s", "opne"), ("t", "2025-19-11T00:00:00Z"), ("z", "-")]):
        data[k * 3][3][f] = v
    want = {(data[k * 3][1], data[k * 3][2], f) for k, f in enumerate(["code", "n", "n", "n", "s", "t", "z"])} | {("j7", "", "s"), ("j7", "", "z")}
    rows_ = [(a, b, c, json.dumps(d)) for a, b, c, d in data] + [("f", "j0", "bad", "{cut"), ("f", "j0", "null", None), (None, "j0", "x", "{}"), ("f", None, "x", '{"n":-5}'), ("f", "j0", "list", "[1]")]
    assert set(rows(profile.find_violations(spark.createDataFrame(rows_, P)))) == want
    assert profile.find_violations(spark.createDataFrame([], P)).count() == 0


def test_file_names(spark, rows):
    names = [f"feed_202501{d:02}_{h:02}.json" for d in range(1, 21) for h in (1, 2)] + ["feed_20251301_01.json", "Copy of feed_20250101_01.json", "feed_20250101_01.json.tmp", "FEED_20250101_01.JSON", None]
    df = spark.createDataFrame([(str(i), "feed", n) for i, n in enumerate(names)], "id string, scope string, file_name string")
    assert rows(profile.malformed_names(df)) == [(str(i),) for i in range(40, 44)]
    assert profile.malformed_names(df.limit(0)).count() == 0


def test_footers(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), (None, 2), ("b" * 100, 3), ("a", None)], "s string, n int").coalesce(1).write.parquet(p)
    df = spark.read.parquet(p)
    f = {r.column: r for r in profile.footer_profile(df).collect()}
    assert (f["s"].nulls, f["n"].nulls, f["n"].lo, f["n"].hi) == (1, 1, "1", "3") and f["s"].hi == "b" * 100
    c = {r.column_name: r for r in profile.column_profile(df, "t").collect()}
    assert (c["s"].n_rows, c["s"].n_nulls, c["s"].distinct_values) == (4, 1, 2)
