"""Expressions over entities: patterns, normal forms, threat levels, enrichment.

All are built-in expressions and stay inside generated code; a null value
gives a null (or 'info' for a threat level), an empty one an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types with a pattern, in the order in which they are tried. (fixed values)
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[(]?[0-9]{1,4}[)]?[-\s\.]?[0-9]{1,4}[-\s\.]?[0-9]{1,9}",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "domain": r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}",
    "url": r"https?://[^\s<>\"{}|\^`\[\]]+",
    "social_handle": r"@[a-zA-Z0-9_]{1,50}",
    "username": r"(?:user(?:name)?|handle|account)[:\s]+([a-zA-Z0-9_.-]+)",
}
#: All entity types. (fixed values)
TYPES = ("person", "organization", "email", "phone", "domain", "ip_address", "social_handle", "username", "address", "credential", "document", "image", "url")
#: Parts of a value that raise the threat score, by type: 4 critical, 3 high, 2 medium. (fixed values)
VALUE_SIGNS = {
    "email": {3: ("protonmail.com", "tutanota.com", "guerrillamail.com", "tempmail.com"), 2: ("yandex.com", "mail.ru")},
    "domain": {4: (".onion", ".i2p"), 3: ("pastebin.com", "ghostbin.com")},
    "ip_address": {3: ("192.168.", "10.", "172.16.")},
}
#: Parts of a tag that raise the threat score. (fixed values)
TAG_SIGNS = {
    4: ("breach", "leaked", "compromised", "ransomware", "apt"),
    3: ("malware", "phishing", "botnet", "c2", "tor"),
    2: ("suspicious", "proxy", "vpn", "anonymous"),
    1: ("spam", "advertising"),
}
#: Version stamp of enriched entities. (fixed value)
ENRICHMENT_VERSION = "1.0.0"

#: What every match of a pattern holds, so that a text without it needs no scan. (follows from the patterns)
NEEDS = {"email": "@", "ip_address": ".", "domain": ".", "url": "://", "social_handle": "@"}

#: What stands at the beginning of every match, looked at without going back, so that most places are passed over at once. (follows from the patterns)
AHEAD = {"domain": r"(?=[a-zA-Z0-9-]{1,63}+\.)", "username": "(?=[uha])"}

#: Patterns a user has added, by type; they come after the built-in ones.
_EXTRA: dict[str, str] = {}


def register_pattern(entity_type: str, pattern: str) -> None:
    """Add (or replace) the pattern of a type; a group in it is what is extracted."""
    _EXTRA[entity_type] = pattern


def patterns() -> dict[str, str]:
    return {**PATTERNS, **_EXTRA}


def matches(text: Column, entity_type: str) -> Column:
    """Distinct matches of a type's pattern, in order of appearance; null text gives null.

    Matching is case-insensitive and sees Unicode letters, digits and spaces.
    """
    p = patterns()[entity_type]
    group = 1 if "(" in p.replace("(?", "").replace(r"\(", "").replace("[(]", "") else 0
    ahead = AHEAD.get(entity_type, "") if entity_type not in _EXTRA else ""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(?iU)" + ahead + p), group))
    if entity_type in NEEDS and entity_type not in _EXTRA:
        return F.when(F.contains(text, F.lit(NEEDS[entity_type])), found).when(text.isNotNull(), F.array().cast("array<string>"))
    return found


def all_matches(text: Column) -> Column:
    """array<struct<seq, entity_type, value>> of every pattern's distinct matches."""

    def tag(i: int, t: str):
        return F.transform(F.coalesce(matches(text, t), F.array().cast("array<string>")), lambda v: F.struct(F.lit(i).alias("seq"), F.lit(t).alias("entity_type"), v.alias("value")))

    return F.concat(*[tag(i, t) for i, t in enumerate(patterns())])


def strip(value: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def normalize(entity_type: Column, value: Column, strict_www: bool = False) -> Column:
    """Normal form of a value by its type.

    A domain loses every leading ``w`` and ``.``, as it always did
    (``web.com`` becomes ``eb.com``); ``strict_www`` removes a ``www.`` only.
    """
    low = strip(F.lower(value))
    domain = F.regexp_replace(low, r"^www\.", "") if strict_www else F.regexp_replace(low, r"^[w.]+", "")
    return (
        F.when(entity_type.isin("email", "username"), low)
        .when(entity_type == "domain", domain)
        .when(entity_type == "phone", F.regexp_replace(value, r"[^0-9+]", ""))
        .when(entity_type == "social_handle", F.regexp_replace(F.lower(value), "^@+", ""))
        .when(entity_type == "url", F.regexp_replace(strip(value), "/+$", ""))
        .otherwise(strip(value))
    )


def _highest(parts: dict[int, tuple[str, ...]], text: Column) -> Column:
    out = F.lit(0)
    for score in sorted(parts):
        hit = F.lit(False)
        for p in parts[score]:
            hit = hit | F.contains(text, F.lit(p))
        out = F.when(hit, F.lit(score)).otherwise(out)
    return out


def value_score(entity_type: Column, normalized: Column) -> Column:
    low, out = F.lower(normalized), F.lit(0)
    for t, parts in VALUE_SIGNS.items():
        out = F.when(entity_type == t, _highest(parts, low)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def tag_score(tags: Column) -> Column:
    return F.coalesce(F.aggregate(tags, F.lit(0), lambda acc, t: F.greatest(acc, F.coalesce(_highest(TAG_SIGNS, F.lower(t)), F.lit(0)))), F.lit(0))


def threat_level(score: Column) -> Column:
    return F.when(score >= 4, "critical").when(score >= 3, "high").when(score >= 2, "medium").when(score >= 1, "low").otherwise("info")


def threat(entity_type: Column, normalized: Column, tags: Column | None = None) -> Column:
    score = value_score(entity_type, normalized)
    return threat_level(score if tags is None else F.greatest(score, tag_score(tags)))


def union_tags(a: Column, b: Column) -> Column:
    """Set union of two tag lists, sorted; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def is_private_ip(ip: Column) -> Column:
    """10/8, 172.16/12, 192.168/16 and 127/8 of a dotted quad; false for anything else."""
    o = F.split(ip, r"\.")
    a, b = (F.expr(f"try_cast({x} as int)") if isinstance(x, str) else x.try_cast("int") for x in (F.get(o, F.lit(0)), F.get(o, F.lit(1))))
    inside = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a == 127)
    return F.coalesce((F.size(o) == 4) & a.isNotNull() & b.isNotNull() & inside, F.lit(False))


def enrichment(entity_type: Column, normalized: Column) -> Column:
    """map of what can be told from the value itself; keys without a value are left out."""
    at = F.split(normalized, "@")
    mail = (entity_type == "email") & (F.size(at) == 2)
    quad = (entity_type == "ip_address") & (F.size(F.split(normalized, r"\.")) == 4)
    host = F.regexp_extract(normalized, "https?://([^/]+)", 1)
    m = F.create_map(
        F.lit("email_domain"), F.when(mail, F.get(at, F.lit(1))),
        F.lit("email_local"), F.when(mail, F.get(at, F.lit(0))),
        F.lit("domain_hash"), F.when(entity_type == "domain", F.substring(F.sha2(normalized, 256), 1, 16)),
        F.lit("is_private"), F.when(quad, is_private_ip(normalized).cast("string")),
        F.lit("url_domain"), F.when((entity_type == "url") & (host != ""), host),
        F.lit("enrichment_version"), F.lit(ENRICHMENT_VERSION),
    )
    return F.map_filter(m, lambda k, v: v.isNotNull())
