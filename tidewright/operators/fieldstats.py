"""Counts over the fields of JSON records, the ground of drift and profile.

Every top-level value has a description of four parts:

======  ==========================================================
form    ``n`` number, ``b`` boolean, ``o`` object or list, ``w`` one short word, or the shape of any other string
digits  how long the runs of digits of a shape are
kind    ``w`` word or boolean, ``n`` number, ``d`` day of a point in time (text or epoch seconds), or ''
key     the word; the number, rounded to 1/32 of its magnitude (also of strings that are numbers); the day
======  ==========================================================

``column_chunks`` lays records out as column chunks, each with its nulls, the
dictionary of its descriptions and the positions of each; ``field_stats``
gives the counts alone.  Both look at whole values: shapes, runs of digits and
names that are long are hashed, not cut.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J

STATS = "scope string, job string, field string, kind string, key string, n bigint"
CHUNKS = "scope string, job string, ids array<string>, cols array<struct<field:string,dict:array<struct<form:string,digits:string,kind:string,key:string,n:int,at:array<int>>>>>"
#: Shapes longer than this are hashed.
LONG = 160
#: Entries a task combines before it hands them on.
FLUSH = 200_000

_TIME = re.compile(r"^(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?$")
_IP = re.compile(r"^\d{1,3}(?:\.\d{1,3}){3}$")
_HEX = re.compile(r"^(?=.*[0-9])(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")
_WORD = re.compile(r"^[^\W\d_]{1,16}$")
_NUMBER = re.compile(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")
_RUN = re.compile(r"[^\W\d_]+|\d+")
_DIGITS = re.compile(r"\d+")


def _run(m: re.Match) -> str:
    t = m[0]
    if t[0].isdigit():
        return "9"
    return "a" if t.islower() else "A" if t.isupper() else "Aa" if t[0].isupper() and t[1:].islower() else "x"


def day_of(text: str) -> int | None:
    """Days since 1970 of an ISO point in time, None if it isn't a real one."""
    m = _TIME.match(text)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    try:
        return dt.date(y, mo, d).toordinal() - 719163 if h < 24 and mi < 60 and s < 61 else None
    except ValueError:
        return None


def _short(text: str) -> str:
    """``text``, or a hash of it where it is long."""
    return text if len(text) <= LONG else "#" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def form_of(text: str) -> tuple[str, str, str, str]:
    """Description of a string; only short ones are remembered."""
    return _remembered(text) if len(text) <= LONG else _form_of(text)


def _form_of(text: str) -> tuple[str, str, str, str]:
    if _WORD.match(text):
        return "w", "", "w", text
    if _TIME.match(text):
        day = day_of(text)
        return ("T", "", "d", str(day)) if day is not None else ("T?", "", "", "")
    if _IP.match(text):
        return ("I" if all(int(x) < 256 for x in text.split(".")) else "I?"), "", "", ""
    if _HEX.match(text):
        return f"h{len(text)}{'a' if text.islower() else 'A'}", "", "", ""
    if _NUMBER.match(text):
        return "N", "", "n", bin_of(float(text))
    return "s" + _short(_RUN.sub(_run, text)), _short(",".join(str(len(x)) for x in _DIGITS.findall(text))), "", ""


_remembered = functools.lru_cache(1 << 17)(_form_of)


def bin_of(x: float) -> str:
    """``x`` rounded to 1/32 of its magnitude."""
    if not math.isfinite(x):
        return "1e308" if x > 0 else "-1e308"
    if x == 0:
        return "0"
    m, e = math.frexp(x)
    return repr(math.ldexp(round(m * 64) / 64, e))


def describe(v) -> tuple[str, str, str, str]:
    """Description of a value made by :func:`jsontext.read`."""
    if isinstance(v, str):
        return _number(v) if type(v) is J.Num else form_of(v)
    if v is True:
        return "b", "", "w", "true"
    if v is False:
        return "b", "", "w", "false"
    if isinstance(v, dict):
        return "o" + _short("{" + ",".join(sorted(v)) + "}"), "", "", ""
    return "o[]", "", "", ""


@functools.lru_cache(1 << 16)
def _number(v: str) -> tuple[str, str, str, str]:
    try:
        x = float(v)
    except ValueError:
        return "n", "", "n", "1e308"
    if 1e9 <= x <= 2.1e9:
        return "n", "", "d", str(int(x // 86400))
    return "n", "", "n", bin_of(x)


#: What stands for null in a dictionary, and the kind under which it notes the commonest value itself.
NULL, TOP = ("", "", "z", ""), "v"


def _top(values: list) -> tuple[str, int] | None:
    """(hash, number) of the commonest value if it is a quarter of all and there twice; one with half of a load is so in its chunks."""
    if not values:
        return None
    try:
        v, n = Counter(values).most_common(1)[0]
    except TypeError:  # objects and lists
        v, n = Counter(map(J.dump, values)).most_common(1)[0]
    if n < 2 or 4 * n < len(values):
        return None
    return blake2b(J.dump(v).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), n


def _layout(batch) -> pa.RecordBatch:
    """The chunks of one batch of records (scope, job, id, data)."""
    blocks: dict[tuple, tuple[list, dict, dict]] = {}
    for sc, jb, rid, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
        d = J.read(text)
        if not isinstance(d, dict):
            continue
        block = blocks.get((sc, jb))
        if block is None:
            block = blocks[sc, jb] = ([], {}, {})
        ids, fields, raw = block
        at = len(ids)
        ids.append(rid)
        for f, v in d.items():
            own = fields.get(f)
            if own is None:
                own = fields[f] = {}
                raw[f] = []
            if v is None:
                k = NULL
            else:
                k = describe(v)
                raw[f].append(v)
            if k in own:
                own[k].append(at)
            else:
                own[k] = [at]
    scope, job, ids, id_ends, names, col_ends, dict_ends, spots, spot_ends = [], [], [], [0], [], [0], [0], [], [0]
    parts: tuple[list, ...] = ([], [], [], [])
    sizes: list[int] = []
    for (sc, jb), (own_ids, fields, raw) in blocks.items():
        scope.append(sc)
        job.append(jb)
        ids += own_ids
        id_ends.append(len(ids))
        for f, own in fields.items():
            names.append(f)
            for k, where in own.items():
                for c, x in zip(parts, k):
                    c.append(x)
                sizes.append(len(where))
                if k is not NULL:
                    spots += where
                spot_ends.append(len(spots))
            top = _top(raw[f])
            if top:
                for c, x in zip(parts, ("", "", TOP, top[0])):
                    c.append(x)
                sizes.append(top[1])
                spot_ends.append(len(spots))
            dict_ends.append(len(sizes))
        col_ends.append(len(names))
    ends = lambda x: pa.array(x, pa.int32())
    text = J.strings
    entry = pa.StructArray.from_arrays([*map(text, parts), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends(spot_ends), pa.array(spots, pa.int32()))], names=["form", "digits", "kind", "key", "n", "at"])
    col = pa.StructArray.from_arrays([text(names), pa.ListArray.from_arrays(ends(dict_ends), entry)], names=["field", "dict"])
    return pa.RecordBatch.from_arrays([text(scope), text(job), pa.ListArray.from_arrays(ends(id_ends), text(ids)), pa.ListArray.from_arrays(ends(col_ends), col)], names=["scope", "job", "ids", "cols"])


def column_chunks(records: DataFrame) -> DataFrame:
    """Records (scope, job, id, data) as column chunks: one row per load and Arrow batch.

    ``ids`` names the records of the chunk; ``cols`` holds, of each field, the
    dictionary of the descriptions of its values with their number and
    positions (nulls under kind ``z``, without positions; the commonest value,
    hashed, once more under ``v`` if it is a quarter of all).  Unreadable and null data, and records that aren't objects, are in no chunk.
    """
    return records.select("scope", "job", "id", "data").mapInArrow(lambda batches: map(_layout, batches), CHUNKS)


def field_stats(records: DataFrame, scope: str = "scope", job: str = "job", data: str = "data", values: bool = True) -> DataFrame:
    """(scope, job, field, kind, key, n) over all readable records: forms (``c``), words, numbers and days, JSON types (``j``).

    ``r`` with an empty field counts readable records.  Unreadable and null data, and records that aren't objects, count nowhere.
    """

    def run(batches):
        got: dict[tuple, int] = {}

        def flush():
            k = list(got)
            cols = [J.strings([x[i] for x in k]) for i in range(5)]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(list(got.values()), pa.int64())], names=["scope", "job", "field", "kind", "key", "n"])
            got.clear()
            return out

        for b in batches:
            for sc, jb, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                d = J.read(text)
                if not isinstance(d, dict):
                    continue
                k = (sc, jb, "", "r", "")
                got[k] = got.get(k, 0) + 1
                for f, v in d.items():
                    k = (sc, jb, f, "j", J.kind(v))
                    got[k] = got.get(k, 0) + 1
                    if v is not None and values:
                        form, _, kind, key = describe(v)
                        k = (sc, jb, f, "c", form)
                        got[k] = got.get(k, 0) + 1
                        if kind:
                            k = (sc, jb, f, kind, key)
                            got[k] = got.get(k, 0) + 1
            if len(got) > FLUSH:
                yield flush()
        yield flush()

    rows = records.select(F.col(scope).alias("s"), F.col(job).alias("j"), F.col(data).alias("d")).where("d is not null")
    return rows.mapInArrow(run, STATS).groupBy("scope", "job", "field", "kind", "key").agg(F.sum("n").alias("n"))
