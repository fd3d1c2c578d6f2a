"""Hidden copies against exact digests, field parsing, collisions, edge cases."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import formatting as T

REC = "id bigint, kind string, value string"


def test_fields():
    want = [("a", "x y"), ("b", "1")]
    for t in ['{"a": "x y", "b": 1}', '"{\\"a\\": \\"x y\\", \\"b\\": 1}"', "{a: 'x y', b: '1'}", "a=x y; b=1", "a=x+y&b=1", 'a="x y" b="1"', "a: x y | b: 1", "a : x y\nb : 1\n"]:
        assert [(k.strip(), v.strip()) for k, v in T.fields_of(t)] == want, t
    assert T.fields_of("n=S%C3%B8r&x=") == [("n", "Sør"), ("x", "")]
    assert T.fields_of("plain words") is None


def test_two_pointers():
    assert T.same_folded("A-b ç1", "«ab»Ç 1") and not T.same_folded("ab", "abc") and T.same_folded("", "--") and not T.same_folded("a1", "a2")
    assert T.same_record("Flow", '{"a":1,"b":2}', "b=2; A=1") and not T.same_record("flow", "a=1; b=2", "a=1; b=2; c=3") and not T.same_record("flow", "a=1", "plain")


def test_hashes_agree_with_comparison():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aAbB1- éÉ·") for _ in range(rng.randrange(5))) for _ in range(400)]
    h, n = T.poly_hashes(texts)
    for a, b in zip(range(0, 400, 2), range(1, 400, 2)):
        assert (h[a] == h[b]) == T.same_folded(texts[a], texts[b])
    assert (n == [len(T._folded(t)) for t in texts]).all()


def _records(rng, n):
    out = []
    for i in range(1, n):
        base = "hot name" if rng.random() < 0.35 else f"name {rng.randrange(60)}"
        v = "".join(rng.choice((c.upper(), c.lower())) for c in base).replace(" ", rng.choice([" ", "-", "", "　"]))
        kind = rng.choice(["vessel", "Vessel", "url"])
        if rng.random() < 0.3:
            f = [("host", base), ("port", str(rng.randrange(3)))]
            rng.shuffle(f)
            kind, v = "service", rng.choice(["; ".join(f"{k}={x}" for k, x in f), "{" + ", ".join(f'"{k.upper()}": "{x}"' for k, x in f) + "}"])
        out.append((i, kind, v))
    return out


def _want(recs):
    g = collections.defaultdict(list)
    for i, k, v in recs:
        if v is not None and k is not None and (T._folded(v)):
            g[T.digest(k, v)].append(i)
    return {(min(x), i) for x in g.values() for i in x if i != min(x)}


def test_copies(spark, rows):
    recs = _records(random.Random(9), 900) + [(2000, "url", None), (2001, "url", " - "), (2002, "url", ""), (2003, None, "name 1"), (2004, "flow", "a=1"), (2005, "FLOW", '{"A": 1, "a": "1"}'), (2006, "flow", "x" * 50_000), (2007, "Flow", "X" * 50_000)]
    df = spark.createDataFrame(recs, REC).withColumns({"h": F.lit(1), "n": F.lit(2), "first_id": F.lit(3)}).repartition(5)
    got = rows(T.hidden_copies(df))
    assert set(got) == _want(recs) and len(set(got)) == len(got) and (2004, 2005) in got and (2006, 2007) in got
    c = {r.first_id: r.copies for r in T.collapsed(df).collect()}
    assert sum(c.values()) == len(recs) and c[2001] == 1


def test_collisions_are_settled(spark, rows, monkeypatch):
    recs = [(i, "url", f"name {i % 7}") for i in range(1, 60)]
    df = spark.createDataFrame(recs, REC)
    same = spark.createDataFrame([(i, 5, k, v) for i, k, v in recs], "id bigint, h bigint, kind string, value string")
    monkeypatch.setattr(T, "hashed_records", lambda _: same)  # all records share one hash
    assert set(rows(T.hidden_copies(df))) == _want(recs)


def test_empty(spark):
    assert T.hidden_copies(spark.createDataFrame([], REC)).count() == 0


def test_powers_grow():
    a, _ = T.poly_hashes(["x" * 200_000])
    b, _ = T.poly_hashes(["-".join("x" * 200_000)])
    assert a.dtype == np.uint64 and a[0] == b[0]


def test_hot_groups_go_by_broadcast(spark, rows, monkeypatch):
    from tidewright.operators import skew

    monkeypatch.setattr(skew, "LEAST", 100)
    monkeypatch.setattr(skew, "HOT", 10)
    recs = _records(random.Random(10), 900)
    df = spark.createDataFrame(recs, REC).repartition(6)
    hashed = T.hashed_records(df)
    assert skew.hot_keys(hashed, "h", hashed.count()).count() >= 1
    assert set(rows(T.hidden_copies(df))) == _want(recs)
