"""Byte-level BPE against a plain merge loop and exact round trips."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import bytebpe as B

regex = pytest.importorskip("regex")
#: The split pattern of the public tokenizer. (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    with open(B.VOCABULARY, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def enc():
    with open(B.VOCABULARY, "rb") as f:
        return B.Encoder(f.read())


def brute(text, ranks):
    out = []
    for piece in regex.findall(PATTERN, text):
        parts = [bytes([x]) for x in piece.encode()]
        while len(parts) > 1:
            r, i = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def split(ids, n):
    off = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


CASES = ["", None, " ", "\n\n  x", "it's they're I'll '", "''s 's x's't", "a b　 c", "１２ ab１ ²", "中文字符测试", "🚢🚢 ok", "<|endoftext|>", "tab\tsep  \t x ", "x" * 700, "!" * 300 + "\n" * 40, "é" * 200, "'" * 9 + "ll"]


def test_cases(enc, ranks):
    assert split(*enc.encode(pa.array(CASES))) == [brute(t or "", ranks) for t in CASES]


def test_random(enc, ranks):
    rng = random.Random(7)
    al = "ab c's't'll \n\t  é中🚢!?\"''LXx10９ "
    texts = ["".join(rng.choice(al) for _ in range(rng.randrange(40))) for _ in range(1500)]
    assert split(*enc.encode(pa.array(texts))) == [brute(t, ranks) for t in texts]
    assert enc.encode(pa.array(texts), False)[1].tolist() == [len(brute(t, ranks)) for t in texts]


def test_forgetting_and_collisions(enc, ranks, monkeypatch):
    monkeypatch.setattr(B, "REMEMBER", 3)
    monkeypatch.setattr(B, "CHUNK", 16)
    with open(B.VOCABULARY, "rb") as f:
        e = B.Encoder(f.read())
    texts = ["alpha beta gamma delta", "beta", "alpha alpha", "gamma zeta eta theta"]
    assert split(*e.encode(pa.array(texts))) == [brute(t, ranks) for t in texts]
    e.letter = np.zeros(256, np.uint64)  # every piece has one hash: lengths and bytes must tell them apart
    e._forget()
    assert split(*e.encode(pa.array(texts))) == [brute(t, ranks) for t in texts]


def test_slices(enc, ranks):
    a = pa.array(["skip", "one two", None, "three"])
    assert split(*enc.encode(a.slice(1))) == [brute(t or "", ranks) for t in ["one two", None, "three"]]


def test_round_trip(enc, ranks):
    back = {v: k for k, v in ranks.items()}
    texts = ["Größe — ok?\r\n\x00\x7f", "नमस्ते दुनिया", "a" * 5000]
    for ids, t in zip(split(*enc.encode(pa.array(texts))), texts):
        assert b"".join(back[i] for i in ids).decode() == t


def test_frames(spark, ranks):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x")], "doc_id bigint, text string").withColumns({"i": F.lit(9), "ids": F.lit("c"), "n": F.lit("d")})
    got = sorted(((r.doc_id, r.ids) for r in B.encode(df).collect()), key=str)
    assert got == sorted([(1, brute("hello world", ranks))] * 2 + [(2, []), (3, []), (None, brute("x", ranks))], key=str)
    assert sorted((r.n for r in B.count_tokens(df).collect())) == [0, 0, 1, 2, 2]
    assert B.encode(df.limit(0)).count() == 0
