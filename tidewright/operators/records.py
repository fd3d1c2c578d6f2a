"""Schemaless JSON records: filter language, paging, search, projection, mutation.

A filter is a dict of field to condition, all joined by AND.  It is compiled to
one predicate over a VARIANT column, so the record is parsed once and count
and page share one filtered plan.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Page bounds and caps of the interface. (fixed values)
MAX_PAGE, DEFAULT_PAGE, EXPORT_CAP = 1000, 100, 10_000


def parsed(data: str | Column) -> Column:
    """VARIANT of JSON text; null where it can't be read."""
    return F.try_parse_json(F.col(data) if isinstance(data, str) else data)


def _path(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def text(v: Column, field: str) -> Column:
    """Text of a field: strings as they are, booleans ``true``, null and absent null."""
    return F.try_variant_get(v, _path(field), "string")


def _literal(x) -> str:
    return x if isinstance(x, str) else json.dumps(x)


def contains(v: Column, path: str, want) -> Column:
    """JSON containment of the constant ``want`` at ``path``: objects by key, arrays as sets, an array holds a bare scalar."""
    if isinstance(want, dict):
        ok = F.try_variant_get(v, path, "map<string,variant>").isNotNull()
        return reduce(lambda a, k: a & contains(v, path + _path(k)[1:], want[k]), want, ok)
    if isinstance(want, list):
        items = F.try_variant_get(v, path, "array<variant>")
        # F.exists takes one-argument functions, so the constant is bound by a factory.
        return reduce(lambda a, w: a & F.exists(items, _element(w)), want, items.isNotNull())
    return _equals(F.try_variant_get(v, path, "variant"), want) | F.coalesce(F.exists(F.try_variant_get(v, path, "array<variant>"), _element(want)), F.lit(False))


def _element(want):
    return lambda x: contains(x, "$", want) if isinstance(want, (dict, list)) else _equals(x, want)


def _equals(x: Column, want) -> Column:
    kind = F.schema_of_variant(x)
    if want is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(want, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == want), F.lit(False))
    if isinstance(want, (int, float)):
        return F.coalesce((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False)) & F.coalesce(F.try_variant_get(x, "$", "double") == float(want), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(x, "$", "string") == want), F.lit(False))


def compile_filter(v: Column, filters: dict, mode: str = "text") -> Column:
    """Predicate of a filter dict.

    scalar: equality as text; list: one of; dict: ``$eq $ne $gt $gte $lt $lte
    $like $contains``.  Order comparisons compare text in mode ``text`` and
    numbers in mode ``typed`` (a value that is no number never matches).  None
    asks for null or absence; an unknown operator is an error.
    """
    if mode not in ("text", "typed"):
        raise ValueError(f"mode {mode!r}")
    order = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
    out: list[Column] = []
    for field, cond in filters.items():
        t = text(v, field)
        if isinstance(cond, list):
            out.append(t.isin([_literal(x) for x in cond]) if cond else F.lit(False))
        elif isinstance(cond, dict):
            for op, x in cond.items():
                if op == "$eq":
                    out.append(t.isNull() if x is None else t == _literal(x))
                elif op == "$ne":
                    out.append(t.isNotNull() if x is None else t != _literal(x))
                elif op in order:
                    if mode == "typed":
                        out.append(getattr(t.try_cast("double"), order[op])(F.lit(float(x))))
                    else:
                        out.append(getattr(t, order[op])(F.lit(_literal(x))))
                elif op == "$like":
                    out.append(t.ilike(f"%{_literal(x)}%"))
                elif op == "$contains":
                    out.append(contains(v, _path(field), x))
                else:
                    raise ValueError(f"unknown operator {op!r}")
        else:
            out.append(t.isNull() if cond is None else t == _literal(cond))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def query(df: DataFrame, filters: dict, *, mode: str = "text", order_by: str | None = None, ascending: bool = False, limit: int = DEFAULT_PAGE, offset: int = 0, data: str = "data", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(page, one-row count) of the records that a filter matches.

    Ordered by a JSON field as text, nulls last ascending and first descending,
    or by newest ``created_at``; always by key after that, so pages are stable.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    hit = df.withColumn("_v", parsed(data)).where(compile_filter(F.col("_v"), filters, mode))
    if order_by:
        t = text(F.col("_v"), order_by)
        order = t.asc_nulls_last() if ascending else t.desc_nulls_first()
    else:
        order = F.col("created_at").desc_nulls_first()
    page = hit.orderBy(order, key).offset(offset).limit(limit).drop("_v")
    return page, hit.agg(F.count("*").alias("total_count"))


def listing(df: DataFrame, newest: str, key: str = "id", limit: int = DEFAULT_PAGE, offset: int = 0, **equal) -> DataFrame:
    """Rows that equal every given value (None: any), newest first, one page of them."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(F.col(newest).desc_nulls_last(), key).offset(offset).limit(limit)


def lookup(df: DataFrame, **key) -> DataFrame:
    """The row of a key: none or one."""
    return listing(df, next(iter(key)), next(iter(key)), 1, 0, **key)


def search(df: DataFrame, term: str, *columns: str, arrays: tuple[str, ...] = (), data: str | None = None) -> DataFrame:
    """Rows in which any column, array element or JSON value contains the term, whatever its case."""
    low = F.lit(term.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), low), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(c, lambda t: F.contains(F.lower(t), low)), F.lit(False))
    if data:
        values = F.map_values(F.try_variant_get(parsed(data), "$", "map<string,string>"))
        hit = hit | F.coalesce(F.exists(values, lambda t: F.coalesce(F.contains(F.lower(t), low), F.lit(False))), F.lit(False))
    return df.where(hit)


def shorten(value: Column, width: int = 40) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))).otherwise(value)


def display(v: Column, field: str) -> Column:
    """A value for people: ``-`` for null, text, ``true``, JSON of anything nested."""
    return F.coalesce(text(v, field), F.lit("-"))


def table_view(df: DataFrame, fields: list[str], data: str = "data", key: str = "id") -> DataFrame:
    """Key and the first five fields of a schema, shortened for display."""
    rows = df.withColumn("_v", parsed(data))
    return rows.select(key, *[shorten(display(F.col("_v"), f)).alias(f) for f in fields[:5]])


def field_names(df: DataFrame, data: str = "data") -> DataFrame:
    """(field_name, n): the union of top-level fields over all readable records."""
    m = F.try_variant_get(parsed(data), "$", "map<string,variant>")
    return df.select(F.explode(F.map_keys(m)).alias("field_name")).groupBy("field_name").agg(F.count("*").alias("n"))


def update(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the columns of ``changes`` (key, columns...) put in place; unknown keys are ignored."""
    c = changes.alias("c")
    new = [x for x in changes.columns if x != key]
    cols = [F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"r.{x}")).alias(x) if x in new else F.col(f"r.{x}") for x in df.columns]
    return df.alias("r").join(c, F.col(f"r.{key}") == F.col(f"c.{key}"), "left").select(*cols)


def patch(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """As :func:`update`, but null in ``changes`` leaves a column as it is."""
    new = [x for x in changes.columns if x != key]
    cols = [F.coalesce(f"c.{x}", f"r.{x}").alias(x) if x in new else F.col(f"r.{x}") for x in df.columns]
    return df.alias("r").join(changes.alias("c"), F.col(f"r.{key}") == F.col(f"c.{key}"), "left").select(*cols)


def delete(df: DataFrame, gone: DataFrame, key: str = "id", parent: str | None = None) -> DataFrame:
    """Rows whose key (or ``parent`` key, for a cascade) isn't in ``gone``."""
    c = parent or key
    return df.join(gone.select(F.col(key).alias(c)).where(F.col(c).isNotNull()).distinct(), c, "left_anti").select(*df.columns)
