"""JSON as it was written: numbers keep their text, broken input gives None."""

from __future__ import annotations

import json

import pyarrow as pa

#: What an object of the input may be nested in before it counts as unreadable.
MAX_DEPTH = 900


class Num(str):
    """A JSON number, as written."""

    __slots__ = ()


_DECODER = json.JSONDecoder(parse_float=Num, parse_int=Num, parse_constant=Num, strict=False)
_PLAIN = json.JSONDecoder(strict=False)


def read(text: str | None, decoder: json.JSONDecoder = _DECODER):
    """Parse ``text``; a JSON string that holds JSON is read as that JSON. None if unreadable."""
    if text is None:
        return None
    try:
        v = decoder.decode(text.strip("﻿ \t\r\n"))
        for _ in range(3):
            if type(v) is not str:
                break
            v = decoder.decode(v.strip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return v


def read_plain(text: str | None):
    """As :func:`read`, with Python numbers."""
    return read(text, _PLAIN)


def dump(v) -> str:
    """Compact JSON text of a value made by :func:`read`."""
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    if type(v) is Num:
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, list):
        return "[" + ",".join(map(dump, v)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x)}" for k, x in v.items()) + "}"


def scalar(v) -> str | None:
    """A string as it is, a number as written, anything else as JSON text; None for null."""
    if v is None:
        return None
    return str(v) if isinstance(v, str) else dump(v)


def kind(v) -> str:
    """JSON type name of a value made by :func:`read`."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if type(v) is Num or isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"




def strings(values: list) -> pa.Array:
    """Arrow text; half a surrogate pair, which JSON can escape and text can't hold, becomes ``?``."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())
