"""Containers: nothing lost, nothing split that fits, little slack."""

import itertools
import random

from pyspark.sql import functions as F

from tidewright.llm import packing as K


def test_fullest_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        counts = {s: rng.randrange(1, 4) for s in rng.sample(range(1, 15), 4)}
        room = rng.randrange(0, 30)
        use = K.fullest(counts, sorted(counts, reverse=True), room)
        assert all(use[s] <= counts[s] for s in use)
        best = max(t for t in (sum(s * k for s, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])) if t <= room)
        assert sum(s * k for s, k in use.items()) == best


def test_plan_covers_every_item_once():
    rng = random.Random(2)
    counts = {s: rng.randrange(1, 500) for s in rng.sample(range(1, 129), 60)}
    rows = K.plan(dict(counts), 128)
    load = {}
    for s, rank, per, first, times in rows:
        for c in range(times):
            load[first + c] = load.get(first + c, 0) + s * per
    assert max(load.values()) <= 128 and set(load) == set(range(len(load)))
    for s, n in counts.items():
        ranks = sorted((r, per * t) for x, r, per, _, t in rows if x == s)
        assert ranks[0][0] == 0 and sum(k for _, k in ranks) == n and all(a + k == b for (a, k), (b, _) in zip(ranks, ranks[1:]))
    least = max(sum(s * n for s, n in counts.items()) / 128, sum(n for s, n in counts.items() if s > 64))
    assert len(load) <= 1.05 * least + 2


def _check(out, sizes, packs, slack=1.1):
    for name, cap in packs.items():
        rows = [r for r in out if r.pack_name == name]
        load, seen = {}, {}
        for r in rows:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            seen.setdefault(r.doc_id, []).append((r.part, r.start_token, r.n_tokens))
        assert max(load.values(), default=0) <= cap
        for d, n in sizes:
            parts = sorted(seen[d])
            assert sum(p[2] for p in parts) == n and [p[1] for p in parts] == [i * cap for i in range(len(parts))]
            assert len(parts) == max(1, -(-n // cap))
        assert len(load) <= slack * sum(n for _, n in sizes) / cap + 3


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 50)  # many shards of one length
    rng = random.Random(3)
    sizes = [(i, 17 if rng.random() < 0.4 else rng.choice([0, 1, 5, 64, 65, 200, rng.randrange(1, 60)])) for i in range(1, 700)]
    packs = {"a": 64, "b": 50}
    df = spark.createDataFrame(sizes, "doc_id bigint, n bigint").withColumns({"p": F.lit(1), "c": F.lit(2), "s": F.lit(3), "len": F.lit(4)})
    _check(K.pack(df, packs).collect(), sizes, packs)


def test_large_capacities(spark):
    """Lengths beyond 16 bits keep to their own pack."""
    rng = random.Random(4)
    sizes = [(i, rng.choice([70_000, 4_464, 65_536, rng.randrange(1, 140_000)])) for i in range(300)] + [(1000 + i, 0) for i in range(50)]
    packs = {"a": 100_000, "b": 131_072, "c": 65_536, "d": 8_192}
    _check(K.pack(spark.createDataFrame(sizes, "doc_id bigint, n bigint"), packs).collect(), sizes, packs, slack=1.4)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, n bigint")
    assert K.pack(none, {"a": 8}).count() == 0
    odd = spark.createDataFrame([(1, 3), (1, 3), (None, 2), (2, None), (3, 0)], "doc_id bigint, n bigint")
    out = K.pack(odd, {"a": 8, "zero": 0, None: 5}).collect()
    assert len(out) == 5 and {r.pack_name for r in out} == {"a"} and sum(r.n_tokens for r in out) == 8
    assert K.pack(odd, {}).count() == 0
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "word " * 50)], "doc_id bigint, text string")
    got = K.pack_texts(docs, spark.createDataFrame([("s", 16)], "pack_name string, capacity int")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and max(r.n_tokens for r in got) == 16
