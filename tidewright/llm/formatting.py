"""Duplicates hidden by formatting (problem 1).

Two records agree when type and value agree once letter case and everything
that is neither a letter nor a digit is disregarded; for types whose value is a
set of named fields, when both hold the same fields in any order.

The characters of a batch stream through one lookup table that skips or folds
them, and a rolling polynomial hash is taken of what remains; canonical
strings are never built.  Fields are hashed one by one and summed, so their
order doesn't count.  Records with equal hash are then compared with the first
of their group by two pointers that skip as they go; should two different
records share a hash, the whole group is settled by exact digests.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys
from ..session import materialize

#: Types whose value is a set of named fields. (fixed values of the task's statement)
FIELD_TYPES = ("service", "whois", "flow")

_M, _R = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_INV = pow(_M, -1, 1 << 64)


@functools.cache
def fold_table() -> np.ndarray:
    """For every code point 0 if it is skipped, else the code point it counts as."""
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        k = unicodedata.category(ch)
        if k[0] == "L" or k == "Nd" or k in ("Nl", "No"):
            f = ch.casefold()
            t[c] = ord(f) if len(f) == 1 else ord(ch.lower()[0]) if len(ch.lower()) == 1 else c
    return t


def poly_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of kept characters) of each text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = fold_table()[cp]
    keep = np.concatenate([[0], np.cumsum(kept > 0)])
    ends = np.cumsum(size)
    a, b = keep[ends - size], keep[ends]
    f = kept[kept > 0].astype(np.uint64)
    with np.errstate(over="ignore"):
        f = (f + np.uint64(1)) * np.uint64(_R)
        f ^= f >> np.uint64(29)
        pw, ip = _powers(len(f) + 1)
        pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(f * pw[: len(f)], dtype=np.uint64)])
        h = (pre[b] - pre[a]) * ip[a]
    return _mix(h + (b - a).astype(np.uint64)), b - a


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


_POW: dict[str, np.ndarray] = {"n": np.zeros(0), "p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        n = max(n, 1 << 16)
        for k, m in (("p", _M), ("i", _INV)):
            x = np.full(n, m, np.uint64)
            x[0] = 1
            _POW[k] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def same_folded(a: str, b: str, table: np.ndarray | None = None) -> bool:
    """Two-pointer comparison that skips what doesn't count."""
    if a == b:
        return True
    fold = _fold_one
    i, j, n, m = 0, 0, len(a), len(b)
    while True:
        x = y = 0
        while i < n and not x:
            x = fold(a[i])
            i += 1
        while j < m and not y:
            y = fold(b[j])
            j += 1
        if x != y:
            return False
        if not x:
            return True


@functools.lru_cache(1 << 16)
def _fold_one(ch: str) -> int:
    return int(fold_table()[ord(ch)])


# ---- named fields -------------------------------------------------------

# Names begin at a boundary and are taken whole, so a long text is scanned once.
_QUOTED = re.compile(r"""(?<![^\s="',;{}|&])([^\s="',;{}|&]++)\s*+=\s*+("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')""")
_COLON_QUOTED = re.compile(r"""(?:^|(?<=[{,\n"']))\s*+["']?(\w[\w .\-]*+)["']?\s*+:\s*+("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[^,'"{}\n]++)\s*+(?:,|\}|$)""")


def _unquote(v: str) -> str:
    v = v.strip()
    return v[1:-1] if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0] else v


def _covers(text: str, rx: re.Pattern, found: list) -> bool:
    """Whether nothing with a letter or digit is left over once the matches are taken out."""
    return bool(found) and not any(_fold_one(c) for c in rx.sub(" ", text))


def fields_of(value: str) -> list[tuple[str, str]] | None:
    """The named fields of a value written as JSON or as text; None if it isn't made of fields."""
    t = value.strip("﻿ \t\r\n")
    if t[:1] == "{" or t[:2] == '"{':
        try:
            d = json.loads(t, parse_int=str, parse_float=str, strict=False)
            if isinstance(d, str):
                d = json.loads(d, parse_int=str, parse_float=str, strict=False)
            if isinstance(d, dict):
                return [(k, "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in d.items()]
        except (ValueError, RecursionError):
            pass
        found = _COLON_QUOTED.findall(t)
        if _covers(t, _COLON_QUOTED, found):
            return [(k, _unquote(v)) for k, v in found]
        t = t.strip("{} \t\r\n")
    found = _QUOTED.findall(t)
    if _covers(t, _QUOTED, found):
        return [(k, _unquote(v)) for k, v in found]
    best: list[tuple[str, str]] | None = None
    for sep, eq in (("&", "="), (";", "="), ("|", ":"), ("\n", ":"), ("|", "="), ("\n", "="), (";", ":"), (",", "="), (",", ":")):
        parts = [p for p in t.split(sep) if any(_fold_one(c) for c in p)]
        if parts and all(eq in p for p in parts) and (best is None or len(parts) > len(best)):
            pairs = [p.split(eq, 1) for p in parts]
            if all(any(_fold_one(c) for c in k) for k, _ in pairs):
                best = [(unquote_plus(k), unquote_plus(v)) if sep == "&" else (k, _unquote(v)) for k, v in pairs]
    return best


def _folded(text: str) -> str:
    """Canonical text; only for types, and for groups in which two records share a hash."""
    return "".join(chr(x) for x in map(_fold_one, text) if x)


_type_key = functools.lru_cache(1 << 14)(_folded)


def _entry(kind: str, value: str):
    """The fields of a value of a type that has them, else None."""
    return fields_of(value) if _type_key(kind) in FIELD_TYPES else None


def _entries(kinds: list[str], values: list[str]) -> list[list[tuple[str, str]] | None]:
    """The distinct fields of each value in the order of their hashes, None for a value without fields; one batch of hashes for all."""
    found = [_entry(k, v) for k, v in zip(kinds, values)]
    hashes = iter(poly_hashes([x for fs in found if fs is not None for f in fs for x in f])[0].tolist())
    out: list = []
    for fs in found:
        if fs is None:
            out.append(None)
            continue
        kept: list[tuple[str, str]] = []
        for _, _, name, value in sorted((next(hashes), next(hashes), *f) for f in fs):
            if not kept or not (same_folded(kept[-1][0], name) and same_folded(kept[-1][1], value)):
                kept.append((name, value))
        out.append(kept)
    return out


def _same(a: str, b: str, x, y) -> bool:
    if x is None or y is None:
        return x is y and same_folded(a, b)
    return len(x) == len(y) and all(same_folded(p[0], q[0]) and same_folded(p[1], q[1]) for p, q in zip(x, y))


def same_records(kinds: list[str], a: list[str], b: list[str]) -> list[bool]:
    """Exact comparison of pairs of values of one type, by two pointers."""
    x, y = _entries(kinds, a), _entries(kinds, b)
    return [p == q or _same(p, q, m, n) for p, q, m, n in zip(a, b, x, y)]


def same_record(kind: str, a: str, b: str) -> bool:
    """:func:`same_records` of one pair."""
    return same_records([kind], [a], [b])[0]


def digest(kind: str, value: str) -> str:
    """Exact canonical digest, for the rare group whose hash isn't enough."""
    fs = _entry(kind, value)
    body = json.dumps(sorted({(_folded(k), _folded(v)) for k, v in fs})) if fs is not None else _folded(value)
    return hashlib.sha256(f"{_type_key(kind)}\0{'f' if fs is not None else 'v'}\0{body}".encode("utf-8", "surrogatepass")).hexdigest()


def record_hashes(kinds: list[str], values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of kept characters) of each record."""
    texts: list[str] = []
    owner: list[int] = []
    plain: list[int] = []
    for i, (k, v) in enumerate(zip(kinds, values)):
        fs = _entry(k, v)
        if fs is None:
            plain.append(i)
            continue
        for name, val in fs:
            texts += (name, val)
            owner.append(i)
    n = len(kinds)
    h, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    types, _ = poly_hashes([_type_key(k) for k in kinds])
    if plain:
        hp, sp = poly_hashes([values[i] for i in plain])
        h[plain], size[plain] = hp, sp
    if owner:
        hf, sf = poly_hashes(texts)
        own = np.array(owner)
        with np.errstate(over="ignore"):
            pair = _mix(hf[0::2] * np.uint64(3) + hf[1::2])
        # A set: a field that is written twice counts once.
        both = np.unique(np.stack([own.astype(np.uint64), pair], 1), axis=0)
        with np.errstate(over="ignore"):
            np.add.at(h, both[:, 0].astype(np.int64), both[:, 1])
        np.add.at(size, own, sf[0::2] + sf[1::2])
        h[np.unique(own)] ^= np.uint64(0x5555555555555555)
    with np.errstate(over="ignore"):
        return _mix(h + types * np.uint64(5)), size


def _hash_batches(batches):
    for b in batches:
        h, size = record_hashes(b.column(1).to_pylist(), b.column(2).to_pylist())
        keep = pa.array(size > 0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64)), b.column(1), b.column(2)], names=["id", "h", "kind", "value"]).filter(keep)


def _verify_batches(batches):
    for b in batches:
        k, v, rk, rv = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
        ok = [_type_key(a) == _type_key(c) and same for a, c, same in zip(k, rk, same_records(k, v, rv))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), pa.array(ok, pa.bool_())], names=["h", "first_id", "copy_id", "ok"])


def _verify_sorted(batches):
    """Rows sorted by (h, id), a group never apart: each row after the first of its group is compared with the first, as they stream by."""
    last = None  # (h, id, kind, value) of the first of the group that is open
    for b in batches:
        ids, h, kinds, values = (b.column(i).to_pylist() for i in range(4))
        first, later = [], []
        for i, x in enumerate(h):
            if last is None or last[0] != x:
                last = (x, ids[i], kinds[i], values[i])
            elif ids[i] != last[1]:  # the same id again is the same record
                first.append(last)
                later.append(i)
        same = same_records([kinds[i] for i in later], [values[i] for i in later], [f[3] for f in first])
        ok = [s and _type_key(kinds[i]) == _type_key(f[2]) for s, i, f in zip(same, later, first)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in first], pa.int64()), pa.array([f[1] for f in first], pa.int64()), pa.array([ids[i] for i in later], pa.int64()), pa.array(ok, pa.bool_())], names=["h", "first_id", "copy_id", "ok"])


PAIRS = "h bigint, first_id bigint, copy_id bigint, ok boolean"


def _pairs(rows: DataFrame) -> DataFrame:
    """Every record after the first of its hash, compared with the first.

    Values cross one shuffle, sorted into their groups; hashes of a thousandth
    of all rows or more, at most a thousand, don't: their first records go to
    the rows by broadcast.
    """
    hot = hot_keys(rows, "h", rows.count())
    cold = rows if hot is None else rows.join(F.broadcast(hot), "h", "left_anti")
    pairs = cold.select("id", "h", "kind", "value").repartition("h").sortWithinPartitions("h", "id").mapInArrow(_verify_sorted, PAIRS)
    if hot is None:
        return pairs
    own = rows.join(F.broadcast(hot), "h")
    first = own.groupBy("h").agg(F.min("id").alias("first_id"))
    reps = own.join(F.broadcast(first), "h").where("id = first_id").dropDuplicates(["h"]).select("h", "first_id", F.col("kind").alias("rk"), F.col("value").alias("rv"))
    more = rows.join(F.broadcast(reps), "h").where("id <> first_id").select("h", "first_id", "kind", "value", "rk", "rv", F.col("id").alias("copy_id"))
    return pairs.unionByName(more.mapInArrow(_verify_batches, PAIRS))


def _digest_batches(batches):
    for b in batches:
        d = list(map(digest, b.column(2).to_pylist(), b.column(3).to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.string())], names=["id", "h", "d"])


def hashed_records(df: DataFrame) -> DataFrame:
    """(id, h, kind, value) of the records that can have copies, from (id, kind, value)."""
    rows = df.select(F.col("id").cast("bigint").alias("id"), F.col("kind").cast("string").alias("kind"), F.col("value").cast("string").alias("value"))
    rows = rows.where("id is not null and kind is not null and value is not null")
    return rows.mapInArrow(_hash_batches, "id bigint, h bigint, kind string, value string")


def hidden_copies(df: DataFrame) -> DataFrame:
    """(first_id, copy_id) from records (id, kind, value); one row per record after the first of its group.

    A null kind or value, and a value without letter or digit, has no copies.
    Ids are unique; a repeated row with the same id is the same record.  An
    empty input gives no rows.
    """
    rows = materialize(hashed_records(df), "formatting")
    found = materialize(_pairs(rows), "formatting-pairs")
    good = found.where("ok").select("h", "first_id", "copy_id").distinct()
    if not found.where("not ok").limit(1).count():
        return good.select("first_id", "copy_id")
    # Different records of one hash: settle those groups by digest.
    mixed = found.where("not ok").select("h").distinct()
    exact = rows.join(mixed, "h", "left_semi").select("id", "h", "kind", "value").mapInArrow(_digest_batches, "id bigint, h bigint, d string")
    firsts = exact.groupBy("h", "d").agg(F.min("id").alias("first_id"))
    exact = exact.join(firsts, ["h", "d"]).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
    return good.join(mixed, "h", "left_anti").select("first_id", "copy_id").unionByName(exact)


def collapsed(df: DataFrame) -> DataFrame:
    """(first_id, copies): each distinct record once, with the number of records it stands for."""
    gone = hidden_copies(df)
    n = gone.groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
    ids = df.select(F.col("id").cast("bigint").alias("first_id")).distinct().join(gone.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return ids.join(n, "first_id", "left").select("first_id", F.coalesce("copies", F.lit(1)).alias("copies"))
