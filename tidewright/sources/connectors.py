"""Connectors: named feeds with a common contract, read from captured responses.

A connector turns a query into a frame of records in one layout.  Here the
answers of the outside services are captured files (JSON, XML or the text a
tool printed); what fetches them is deployment, not engine.  Nothing is ever
written back to a service.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

from ..functions.web import is_domain, is_ip
from .paths import names_below, objects_of

#: States of a connector. (fixed values)
STATUSES = ("disconnected", "connected", "error", "rate_limited")


def _first(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


class _Json:
    """Fields of a VARIANT as text, lists as arrays of text."""

    def __init__(self, v: Column):
        self.v = v

    def __call__(self, path: str) -> Column:
        return F.try_variant_get(self.v, "$." + path, "string")

    def list(self, path: str) -> Column:
        return F.coalesce(F.try_variant_get(self.v, "$." + path, "array<string>"), F.array().cast("array<string>"))


def normalize_attack(v: Column, brand: str | None = None) -> list[Column]:
    j, b = _Json(v), F.lit(brand).cast("string")
    fields = {"entity_type": F.lit("attack"), "source": F.lit("netcraft"), "attack_id": j("id"), "attack_url": _first(j("url"), j("attack_url")), "attack_type": _first(j("attack_type"), j("type")), "status": j("status"), "country": _first(j("country"), j("country_code")), "ip": j("ip"), "domain": j("domain"), "brand": _first(j("brand"), b), "hostname": j("hostname"), "certificate": j("certificate"), "first_seen": _first(j("first_seen"), j("date_reported")), "last_updated": _first(j("last_updated"), j("date_updated")), "region": j("region"), "registrar": j("registrar"), "hosting_provider": _first(j("hosting_provider"), j("hoster")), "target_brand": _first(j("target_brand"), j("brand")), "evidence_url": j("evidence_url"), "screenshot_url": j("screenshot_url")}
    return [c.alias(k) for k, c in fields.items()]


def normalize_takedown(v: Column, brand: str | None = None) -> list[Column]:
    j, b = _Json(v), F.lit(brand).cast("string")
    fields = {"entity_type": F.lit("takedown"), "source": F.lit("netcraft"), "takedown_id": j("id"), "attack_url": _first(j("url"), j("attack_url")), "status": j("status"), "date_submitted": _first(j("date_submitted"), j("submitted")), "date_resolved": _first(j("date_resolved"), j("resolved")), "attack_type": _first(j("attack_type"), j("type")), "brand": _first(j("brand"), b), "domain": j("domain"), "ip": j("ip"), "country": _first(j("country"), j("country_code")), "hostname": j("hostname"), "hosting_provider": _first(j("hosting_provider"), j("hoster")), "registrar": j("registrar"), "resolution": j("resolution")}
    return [c.alias(k) for k, c in fields.items()]


def normalize_info(v: Column) -> list[Column]:
    j = _Json(v)
    return [F.lit("api_info").alias("entity_type"), F.lit("shodan").alias("source"), *[j(k).alias(k) for k in ("query_credits", "scan_credits", "plan")]]


def normalize_host(v: Column) -> list[Column]:
    j = _Json(v)
    services = F.transform(F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"), F.array().cast("array<variant>")), lambda s: F.struct(F.try_variant_get(s, "$.port", "int").alias("port"), F.try_variant_get(s, "$.transport", "string").alias("protocol"), F.try_variant_get(s, "$.product", "string").alias("product"), F.try_variant_get(s, "$.version", "string").alias("version"), F.substring(F.coalesce(F.try_variant_get(s, "$.data", "string"), F.lit("")), 1, 500).alias("banner")))
    return [F.lit("host").alias("entity_type"), F.lit("shodan").alias("source"), j("ip_str").alias("ip"), j.list("hostnames").alias("hostnames"), j("country_code").alias("country"), *[j(k).alias(k) for k in ("city", "org", "asn", "isp")], j.list("ports").alias("ports"), j.list("vulns").alias("vulns"), services.alias("services"), j("last_update").alias("last_update")]


def normalize_domain(v: Column) -> list[Column]:
    j = _Json(v)
    return [F.lit("domain").alias("entity_type"), F.lit("shodan").alias("source"), j("domain").alias("domain"), j.list("subdomains").alias("subdomains"), F.struct(*[j.list(f"data.{k}").alias(k) for k in ("A", "AAAA", "MX", "NS", "TXT")]).alias("dns_records")]


def normalize_match(v: Column) -> list[Column]:
    j = _Json(v)
    return [F.lit("search_result").alias("entity_type"), F.lit("shodan").alias("source"), j("ip_str").alias("ip"), j("port").alias("port"), j("transport").alias("protocol"), j.list("hostnames").alias("hostnames"), j("location.country_code").alias("country"), j("org").alias("org"), j("product").alias("product"), j("version").alias("version"), F.substring(F.coalesce(j("data"), F.lit("")), 1, 500).alias("banner")]


def normalize_alert(v: Column) -> list[Column]:
    j = _Json(v)
    return [F.lit("alert").alias("entity_type"), F.lit("zerofox").alias("source"), j("id").alias("alert_id"), *[j(k).alias(k) for k in ("alert_type", "severity", "status", "rule_name")], j("entity.name").alias("entity"), F.struct(j("offending_content_url").alias("url"), j("content_type").alias("type"), j("content_created_at").alias("created_at")).alias("offending_content"), F.struct(*[j(f"perpetrator.{k}").alias(k) for k in ("username", "url", "network")]).alias("perpetrator"), j("timestamp").alias("timestamp")]


def normalize_protected(v: Column) -> list[Column]:
    j = _Json(v)
    return [F.lit("protected_entity").alias("entity_type"), F.lit("zerofox").alias("source"), j("id").alias("entity_id"), j("name").alias("name"), j("type_id").alias("type"), j("policy_id").alias("policy_id"), j.list("labels").alias("labels"), j("strict_name_matching").alias("strict_name_matching")]


def claimed_accounts(df: DataFrame, username: str, json_col: str) -> DataFrame:
    """Accounts a username tool found: sites with status ``Claimed`` of its JSON answer."""
    m = df.select(F.explode(F.try_variant_get(F.try_parse_json(json_col), "$", "map<string,variant>")).alias("platform", "v")).withColumn("j", F.col("v"))
    j = _Json(F.col("j"))
    return m.where(j("status") == "Claimed").select(F.lit("social_account").alias("entity_type"), F.lit("sherlock").alias("source"), F.lit(username).alias("username"), "platform", j("url_user").alias("url"), j("status").alias("status"), j("response_time_s").alias("response_time"), j("http_status").alias("http_status"))


def printed_accounts(lines: DataFrame, username: str, text: str = "value") -> DataFrame:
    """Accounts from the lines a username tool printed, ``site: url``."""
    t = F.trim(text)
    ok = F.contains(t, F.lit(":")) & F.contains(F.lower(t), F.lit("http"))
    return lines.where(ok).select(F.lit("social_account").alias("entity_type"), F.lit("sherlock").alias("source"), F.lit(username).alias("username"), F.trim(F.expr(f"substring(trim({text}), 1, locate(':', trim({text})) - 1)")).alias("platform"), F.trim(F.expr(f"substring(trim({text}), locate(':', trim({text})) + 1)")).alias("url"), F.lit("found").alias("status"))


def recon_sections(lines: DataFrame, domain: str, file: str = "file", order: str = "line_no", text: str = "value") -> DataFrame:
    """Findings from the sectioned text a recon tool printed; a line belongs to the last heading above it in its file."""
    t = F.trim(text)
    head = F.when(F.contains(t, F.lit("Emails found:")), "emails").when(F.contains(t, F.lit("Hosts found:")), "hosts").when(F.contains(t, F.lit("IPs found:")), "ips").when(F.startswith(t, F.lit("[*]")) | F.startswith(t, F.lit("[-]")), "")
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"t": t, "head": head}).withColumn("section", F.last("head", ignorenulls=True).over(w))
    rows = rows.where("head is null and t <> '' and not startswith(t, '-')")
    mail = (F.col("section") == "emails") & F.contains("t", F.lit("@"))
    parts = F.split("t", ":")
    rows = rows.where(mail | F.col("section").isin("hosts", "ips"))
    return rows.select(
        F.when(mail, "email").when(F.col("section") == "hosts", "subdomain").otherwise("ip_address").alias("entity_type"),
        F.lit("harvester").alias("source"),
        F.lit(domain).alias("domain"),
        F.when(mail, F.col("t")).alias("email"),
        F.when(F.col("section") == "hosts", F.trim(F.get(parts, F.lit(0)))).alias("subdomain"),
        F.when(F.col("section") == "hosts", F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).when(F.col("section") == "ips", F.col("t")).alias("ip"),
    )


def recon_xml(df: DataFrame, domain: str, xml: str) -> DataFrame:
    """Findings from a recon tool's XML: every ``email``, ``host`` (with its ip) and ``ip``."""
    get = lambda tag: F.filter(F.transform(F.expr(f"xpath({xml}, '//{tag}/text()')"), lambda x: F.trim(x)), lambda x: x != "")
    base = df.select(get("email").alias("e"), get("host").alias("h"), F.expr(f"xpath({xml}, '//host[text()]/@ip')").alias("hi"), get("ip").alias("i"))
    n = F.lit(None).cast("string")
    out = lambda kind, e, s, i: F.struct(F.lit(kind).alias("entity_type"), F.lit("harvester").alias("source"), F.lit(domain).alias("domain"), e.alias("email"), s.alias("subdomain"), i.alias("ip"))
    rows = F.concat(F.transform("e", lambda x: out("email", x, n, n)), F.transform("h", lambda x, k: out("subdomain", n, x, F.coalesce(F.get("hi", k), F.lit("")))), F.transform("i", lambda x: out("ip_address", n, n, x)))
    return base.select(F.explode(rows).alias("r")).select("r.*")


class RateLimited(Exception):
    """A feed refuses to answer for now; a connector raises it when its service says so."""


@dataclass
class Result:
    """Answer of one connector."""

    name: str
    data: DataFrame | None
    status: str = "connected"
    errors: list[str] = field(default_factory=list)


@dataclass
class Connector:
    """A feed: ``routes`` map the kind of a query to a captured file and its normaliser."""

    name: str
    base: str
    status: str = "disconnected"

    def connect(self, spark: SparkSession) -> bool:
        self.status = "connected"
        return True

    def health(self) -> dict:
        return {"name": self.name, "healthy": self.status == "connected", "status": self.status}

    def _json(self, spark: SparkSession, file: str) -> DataFrame:
        """Objects of a captured answer, one VARIANT per row: of a list its items, else the document."""
        text = spark.read.text(f"{self.base}/{file}", wholetext=True).select(F.try_parse_json("value").alias("v"))
        return text.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))

    def fetch(self, spark: SparkSession, query: str | None = None) -> Result:
        raise NotImplementedError


class ScanConnector(Connector):
    """Internet scans: no query asks for the account, an IP for its host, a domain for its DNS, anything else searches (100 at most)."""

    def fetch(self, spark, query=None):
        kind = "info"
        if query:
            q = spark.range(1).select(F.when(is_ip(F.lit(query)), "host").when(is_domain(F.lit(query)), "domain").otherwise("search").alias("k"))
            kind = q.first()[0]
        file, norm = {"info": ("info.json", normalize_info), "host": ("host.json", normalize_host), "domain": ("domain.json", normalize_domain), "search": ("search.json", normalize_match)}[kind]
        rows = self._json(spark, file)
        return Result(self.name, (rows.limit(100) if kind == "search" else rows).select(*norm(F.col("v"))))


class AlertConnector(Connector):
    """Open alerts (100 at most, matching the query) and protected entities."""

    def fetch(self, spark, query=None):
        a = self._json(spark, "alerts.json").select(*normalize_alert(F.col("v"))).where("lower(status) = 'open'")
        if query:
            a = a.where(F.contains(F.lower(F.coalesce("entity", F.lit(""))), F.lit(query.lower())) | F.contains(F.lower(F.coalesce("rule_name", F.lit(""))), F.lit(query.lower())))
        e = self._json(spark, "entities.json").select(*normalize_protected(F.col("v")))
        return Result(self.name, a.orderBy("alert_id").limit(100).unionByName(e, allowMissingColumns=True))


class TakedownConnector(Connector):
    """Attacks and takedowns; ``takedowns`` asks for those alone, a URL or word for matching attacks."""

    def fetch(self, spark, query=None):
        a = self._json(spark, "attacks.json").select(*normalize_attack(F.col("v")))
        t = self._json(spark, "takedowns.json").select(*normalize_takedown(F.col("v")))
        if query == "takedowns":
            return Result(self.name, t)
        if query:
            col = "attack_url" if query.startswith("http") else "domain"
            return Result(self.name, a.where(F.contains(col, F.lit(query))))
        return Result(self.name, a.unionByName(t, allowMissingColumns=True))


#: Connector types by name; more can be registered.
TYPES: dict[str, type[Connector]] = {"shodan": ScanConnector, "zerofox": AlertConnector, "netcraft": TakedownConnector}


def register(kind: str, cls: type[Connector]) -> None:
    TYPES[kind] = cls


def fetch_all(spark: SparkSession, connectors: list[Connector], query: str | None = None) -> tuple[DataFrame | None, list[Result]]:
    """Union of all answers by column name; a connector that fails is left out and says why."""
    results = []
    for c in connectors:
        try:
            c.connect(spark)
            results.append(c.fetch(spark, query))
        except Exception as e:  # a feed that fails must not stop the others
            c.status = "rate_limited" if isinstance(e, RateLimited) else "error"
            results.append(Result(c.name, None, c.status, [str(e)[:500]]))
    frames = [r.data for r in results if r.data is not None]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), results


class CapturedFeed(DataSource):
    """Spark data source ``captured``: the objects of captured JSON answers as rows (feed, data); as a stream, a folder polled for new ones."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "feed string, data string"

    def reader(self, schema):
        return _CapturedReader(self.options)

    def streamReader(self, schema):
        return _PolledReader(self.options)


class _CapturedReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        yield from _feed_rows(partition.value)


def _feed_rows(path: str):
    feed = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for x in objects_of(path):
        yield (feed, json.dumps(x, ensure_ascii=False))


class _PolledReader(DataSourceStreamReader):
    """Polls a folder: each poll reads the files that came since the last, by name, a task each."""

    def __init__(self, options):
        self.folder = options.get("path", "")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = names_below(self.folder)
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(f) for f in names_below(self.folder) if start["after"] < f <= end["after"]]

    def read(self, partition):
        yield from _feed_rows(partition.value)
