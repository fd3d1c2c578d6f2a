"""Deeply nested records as flat tables (problem 3).

Every object gets a Merkle identity: its body (JSON with sorted keys, in which
nested objects are replaced by references to their identities) is hashed
bottom-up, so equal subtrees share one identity wherever they occur.
``occurrences`` keeps one bridge row per occurrence with parent, path and
ordinal; ``objects`` keeps the body of every distinct object once.  Both come
from the same pass over the records, without a shuffle for the bridge; the
store of objects is combined in each task before it is shuffled by identity.

Bridge and store hold all there is: ``rebuild`` puts a record together again.
The bridge carries the few scalar fields a query asks for (``promote``), which
spares a join of all occurrences with the store.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import blake2b
from json.encoder import encode_basestring as quoted

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J

#: Keys whose objects are rows of child tables. (fixed values of the task's statement)
CHILD_KEYS = ("commercial_vessels", "fishing_vessels", "escorts", "legs", "waypoints", "services", "vulns", "MX")

BRIDGE = "record_id string, parent_path string, child_path string, table_name string, ordinal int, object_id string, parent_id string"

#: The only key of a reference to an object.
REF = "#"
#: Distinct objects that a task remembers before it hands them on; a bound on memory, not on results.
STORE_LIMIT = 200_000


def identities(root, bodies: dict[str, str] | None = None) -> dict[int, str]:
    """Identity of every object below ``root``, by ``id``, and of ``root`` itself; bodies are noted by identity.

    Works through an explicit stack, so any depth that can be parsed will do.
    """
    parts: dict[int, str] = {}
    found: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        v, ready = stack.pop()
        inner = v.values() if type(v) is dict else v
        if not ready:
            stack.append((v, True))
            stack += [(x, False) for x in inner if type(x) is dict or type(x) is list]
            continue
        if type(v) is dict:
            text = "{" + ",".join([f"{quoted(k)}:{_part(x, parts)}" for k, x in sorted(v.items())]) + "}"
        else:
            text = "[" + ",".join([_part(x, parts) for x in v]) + "]"
        if type(v) is dict or v is root:
            h = found[id(v)] = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            parts[id(v)] = f'{{"{REF}":"{h}"}}'
            if bodies is not None:
                bodies[h] = text
        else:
            parts[id(v)] = text
    return found


def _part(x, parts: dict[int, str]) -> str:
    if type(x) is dict or type(x) is list:
        return parts[id(x)]
    return quoted(x) if type(x) is str else J.dump(x)


def walk(root, found: dict[int, str], keys: frozenset | None) -> list[tuple]:
    """(parent path, path, key, ordinal, object, identity of the parent) of every object under one of ``keys``; of every object and the root if None."""
    out = []
    stack = [(root, "", ("", None), "" if keys is None else None, 0)]
    while stack:
        v, path, parent, key, ordinal = stack.pop()
        if type(v) is dict or key == "" and v is root:
            if key is not None:
                out.append((parent[0], path, key, ordinal, v, parent[1]))
                parent = (path, found[id(v)])
        if type(v) is dict:
            dot = path + "." if path else ""
            inner = [(x, dot + k, parent, k if keys is None or k in keys else None, 0) for k, x in v.items() if type(x) is dict or type(x) is list]
        else:
            inner = [(x, f"{path}[{i}]", parent, key, i) for i, x in enumerate(v) if type(x) is dict or type(x) is list]
        stack += reversed(inner)
    return out


def rebuild(object_id: str, body_of: Callable[[str], str]):
    """The object of an identity, from the bodies of the store; key order aside it is the original."""

    def lookup(d: dict):
        return rebuild(d[REF], body_of) if d.keys() == {REF} else d

    v = json.loads(body_of(object_id), parse_int=J.Num, parse_float=J.Num)
    fill = lambda x: lookup(x) if isinstance(x, dict) else [fill(y) for y in x] if isinstance(x, list) else x
    return {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else fill(v)


def _may_hold(data: Column, keys) -> Column:
    """Cheap test that a record can hold a child object; a backslash-u could hide a key."""
    test = data.contains("\\u")
    for k in keys:
        test = test | data.contains(k)
    return test


def _parsed(texts):
    for t in texts:
        v = J.read(t)
        yield v if isinstance(v, (dict, list)) else None


def occurrences(df: DataFrame, id_col: str = "id", data_col: str = "data", keys: tuple[str, ...] | None = CHILD_KEYS, promote: tuple[str, ...] = ("lat",)) -> DataFrame:
    """One bridge row per object under a child key, at any depth; with ``keys`` None, of every object and of the record itself.

    Null, cut-off or otherwise unreadable data gives no row, as does nesting
    deeper than the JSON parser takes.  A promoted field that is absent or null
    is ''.  Equal records give equal rows under their own ids.  The row of the
    record has path '' and no key; elements of lists bear the key of the list.
    """
    names = [c.split()[0] for c in BRIDGE.split(", ")] + list(promote)
    wanted = None if keys is None else frozenset(keys)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for rid, v in zip(b.column(0).to_pylist(), _parsed(b.column(1).to_pylist())):
                if v is None:
                    continue
                found = identities(v)
                for par, path, key, n, obj, ph in walk(v, found, wanted):
                    vals = (rid, par, path, key, n, found[id(obj)], ph, *[(J.scalar(obj.get(p)) or "" if type(obj) is dict else "") for p in promote])
                    for c, x in zip(cols, vals):
                        c.append(x)
            arrays = [pa.array(c, pa.int32()) if n == "ordinal" else J.strings(c) for c, n in zip(cols, names)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(data_col).alias("d"))
    rows = rows.where("d is not null") if keys is None else rows.where(_may_hold(F.col("d"), keys))
    return rows.mapInArrow(run, BRIDGE + "".join(f", {p} string" for p in promote))


def objects(df: DataFrame, data_col: str = "data", keys: tuple[str, ...] | None = None) -> DataFrame:
    """(object_id, body, n): every distinct object once, with its body and how often it occurs; those under ``keys`` only, if given.

    A body is JSON with sorted keys, numbers as written, and ``{"#": identity}``
    in place of each object in it, lists of any depth included.  A record that
    is a list has a body of its own.
    """
    wanted = None if keys is None else frozenset(keys)

    def run(batches):
        seen: dict[str, list] = {}

        def flush():
            arrays = [pa.array(list(seen), pa.string()), J.strings([x[0] for x in seen.values()]), pa.array([x[1] for x in seen.values()], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["object_id", "body", "n"])

        for b in batches:
            for v in _parsed(b.column(0).to_pylist()):
                if v is None:
                    continue
                bodies: dict[str, str] = {}
                found = identities(v, bodies)
                for *_, obj, _ph in walk(v, found, wanted):
                    h = found[id(obj)]
                    x = seen.get(h)
                    if x is None:
                        seen[h] = [bodies[h], 1]
                    else:
                        x[1] += 1
            if len(seen) > STORE_LIMIT:
                yield flush()
        yield flush()

    rows = df.select(F.col(data_col).alias("d"))
    rows = rows.where("d is not null") if keys is None else rows.where(_may_hold(F.col("d"), keys))
    return rows.mapInArrow(run, "object_id string, body string, n bigint").groupBy("object_id").agg(F.min("body").alias("body"), F.sum("n").alias("n"))
