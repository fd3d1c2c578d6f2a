"""Expressions over requests, paths, files and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paths that are not audited, and the action of each method. (fixed values)
EXCLUDED = ("/health", "/metrics", "/docs", "/openapi.json", "/redoc", "/api/compliance/audit", "/api/compliance/integrity/verify", "/api/compliance/report")
ACTIONS = {"GET": "read", "POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}
#: Upper bounds of the latency buckets in seconds. (fixed values)
BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
MIME = {"json": "application/json", "csv": "text/csv", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pdf": "application/pdf", "txt": "text/plain"}

_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def normalize_path(path: Column) -> Column:
    """Parts that are UUIDs or digits become ``{id}``."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.when(p.rlike(_UUID) | p.rlike(r"^\d+$"), "{id}").otherwise(p)), "/")


def resource(path: Column) -> Column:
    """struct(resource_type, resource_id): the part after a leading ``api``, and the next unless it begins with ``_``."""
    p = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    p = F.when(F.get(p, F.lit(0)) == "api", F.slice(p, 2, 1000)).otherwise(p)
    rid = F.get(p, F.lit(1))
    return F.struct(F.coalesce(F.get(p, F.lit(0)), F.lit("unknown")).alias("resource_type"), F.when((rid != "") & ~F.startswith(rid, F.lit("_")), rid).alias("resource_id"))


def audited(path: Column) -> Column:
    return ~F.exists(F.array(*map(F.lit, EXCLUDED)), lambda p: F.startswith(path, p))


def action(method: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return F.coalesce(m[F.upper(method)], F.lit("read"))


def client_ip(forwarded: Column, peer: Column, real: Column | None = None) -> Column:
    """First forwarded address, else the one a proxy vouches for, else the peer, else ``unknown``."""
    first = F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))
    return F.coalesce(first, *([F.nullif(real, F.lit(""))] if real is not None else []), peer, F.lit("unknown"))


def counters(requests: DataFrame, *labels: str) -> DataFrame:
    """(labels..., n): how often each combination of labels was counted."""
    return requests.groupBy(*labels).agg(F.count("*").alias("n"))


def gauge(changes: DataFrame, at: str, delta: str, size: str = "HOUR") -> DataFrame:
    """(at, value): a gauge at the end of each hour in which it moved, from its ups and downs; one row per hour is added up."""
    steps = changes.groupBy(F.date_trunc(size, at).alias("at")).agg(F.sum(delta).alias("d"))
    return steps.select("at", F.sum("d").over(Window.orderBy("at")).alias("value"))


def is_ip(q: Column) -> Column:
    return q.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def is_domain(q: Column) -> Column:
    return q.rlike(r"^[a-zA-Z0-9][-a-zA-Z0-9]*(\.[a-zA-Z0-9][-a-zA-Z0-9]*)+$") & ~is_ip(q)


def time_ago(at: Column, now: Column) -> Column:
    """``Just now``, ``5m ago``, ``3h ago`` or ``2d ago``."""
    m = F.timestamp_diff("MINUTE", at, now)
    return F.when(m < 1, "Just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))


def file_size(n: Column) -> Column:
    """``0 Bytes``, ``1.5 KB`` and so on, two decimals at most."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    x = F.round(n / F.pow(F.lit(1024.0), unit), 2)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), F.get(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), unit)))


def mime(name: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(m[F.lower(F.element_at(F.split(name, r"\."), -1))], F.lit("application/octet-stream"))
