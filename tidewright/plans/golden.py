"""Expected rows of the queries over literal inputs, worked out by hand, as SQL."""

from __future__ import annotations


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(columns: str, rows: list[tuple], casts: dict[str, str] | None = None) -> str:
    """``SELECT`` of literal rows; ``columns`` are names apart by blanks, ``casts`` the types of those that literals leave open."""
    names = columns.split()
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    picked = ", ".join(f"{n}::{casts[n]} AS {n}" if casts and n in casts else n for n in names)
    return f"SELECT {picked} FROM (VALUES {body}) t({', '.join(names)})"


SQL = {
    # Headers lose their delimiter, cells their type; short rows are padded, long ones cut with a warning; equal headers: the last wins.
    "parse_uploads": values(
        "file row_number source_sheet data severity",
        [
            ("a.csv", 2, None, '{"a": 1, "b": 2}', None),
            ("a.csv", 3, None, '{"a": 3, "b": 4}', None),
            ("b.csv", 2, None, '{"x": 1, "y": null}', None),
            ("b.csv", 3, None, None, "warning"),
            ("b.csv", 3, None, '{"x": 1, "y": 2}', None),
            ("b.csv", 4, None, '{"x": true, "y": null}', None),
            ("dup.csv", 2, None, '{"a": 2}', None),
            ("latin.csv", 2, None, '{"name": "café", "n": 1}', None),
            ("a.json", 1, None, '{"a": 1}', None),
            ("a.json", 2, None, '{"a": "x"}', None),
            ("a.json", 3, None, None, "error"),
            ("one.json", 1, None, '{"k": {"z": 1}}', None),
            ("root.json", None, None, None, "error"),
            ("a.jsonl", 1, None, '{"a": 1}', None),
            ("a.jsonl", 3, None, None, "error"),
            ("a.jsonl", 4, None, '{"a": 2}', None),
            ("a.txt", None, None, None, "error"),
            ("a.xlsx", 2, "Data", '{"a": "1", "b_c": null}', None),
            ("a.xlsx", 4, "Data", '{"a": "x", "b_c": "y"}', None),
        ],
        {"row_number": "BIGINT"},
    ),
    # A file fails when all that is wrong with it are errors.
    "upload_jobs": values(
        "file state total_records processed_records n_errors n_warnings",
        [
            ("a.csv", "complete", 2, 2, 0, 0),
            ("b.csv", "complete", 3, 3, 0, 1),
            ("dup.csv", "complete", 1, 1, 0, 0),
            ("latin.csv", "complete", 1, 1, 0, 0),
            ("a.json", "failed", 2, 0, 1, 0),
            ("one.json", "complete", 1, 1, 0, 0),
            ("root.json", "failed", 0, 0, 1, 0),
            ("a.jsonl", "failed", 2, 0, 1, 0),
            ("a.txt", "failed", 0, 0, 1, 0),
        ],
        {c: "BIGINT" for c in ("total_records", "processed_records", "n_errors", "n_warnings")},
    ),
    "connector_union": values(
        "entity_type source status attack_url entity plan",
        [
            ("api_info", "shodan", None, None, None, "dev"),
            ("alert", "zerofox", "Open", None, "Brand", None),
            ("protected_entity", "zerofox", None, None, None, None),
            ("attack", "netcraft", None, "https://x.invalid/1", None, None),
            ("takedown", "netcraft", None, "https://x.invalid/1", None, None),
        ],
    ),
    "connector_hosts": "SELECT '192.0.2.7' AS ip, 'XA' AS country, 22::INT AS port, 500::BIGINT AS banner_length",
    "connector_states": values("name healthy status", [("scan", True, "connected"), ("closed", False, "error"), ("busy", False, "rate_limited")]),
    "connector_recon": values(
        "entity_type source domain email subdomain ip",
        [
            ("email", "harvester", "x.example", "a@x.example", None, None),
            ("subdomain", "harvester", "x.example", None, "www.x.example", "192.0.2.1"),
            ("subdomain", "harvester", "x.example", None, "mail.x.example", ""),
            ("ip_address", "harvester", "x.example", None, None, "192.0.2.9"),
            ("email", "harvester", "x.example", "b@x.example", None, None),
            ("subdomain", "harvester", "x.example", None, "ftp.x.example", "192.0.2.2"),
            ("ip_address", "harvester", "x.example", None, None, "192.0.2.3"),
        ],
    ),
    "connector_accounts": values("platform url status", [("SiteA", "https://a.example/u", "Claimed"), ("SiteC", "https://c.example/u", "found")]),
    # A leading w or dot is stripped from domains, so a host cut at www. loses it; digits of an address read as a phone number.
    "pipeline_records": values(
        "entity_type normalized_value threat_level n_mentions",
        [
            ("email", "bob@protonmail.com", "high", 2),
            ("domain", "protonmail.com", "info", 2),
            ("social_handle", "protonmail", "info", 2),
            ("social_handle", "amy", "info", 1),
            ("url", "https://www.web.com/a", "info", 1),
            ("domain", "eb.com", "info", 1),
            ("ip_address", "10.0.0.12", "high", 1),
            ("phone", "100012", "info", 1),
        ],
        {"n_mentions": "BIGINT"},
    ),
    # An attack with its address and host, and a takedown whose date reads as a phone number.
    "connector_ingest": values(
        "part kind n",
        [
            ("job", "complete:connector_takedowns", 2),
            ("entities", "url", 1),
            ("entities", "domain", 1),
            ("entities", "phone", 1),
            ("nodes", "URL", 1),
            ("nodes", "Domain", 1),
            ("nodes", "Phone", 1),
            ("edges", "ASSOCIATED_WITH", 1),
            ("events", "ingestion.complete", 1),
        ],
        {"n": "BIGINT"},
    ),
    "object_store": values("bucket path size content", [("raw", "w/j/a.csv", 4, "a;b\n"), ("reports", "r.json", 2, "{}")], {"size": "BIGINT"}),
    "workbook_sheets": values("sheet rows", [("Data", 2), ("Notes", 1)], {"rows": "BIGINT"}),
    "schema_profile_excel": values(
        "name inferred_type nullable samples confidence",
        [("when", "datetime", True, "2025-01-01,2025-01-02T00:00", 1.0), ("n", "int", False, "1,2,3", 0.666667), ("text", "str", False, "a,b,7", 1.0)],
        {"confidence": "DOUBLE"},
    ),
    "workflow_push": values("workspace_id schema_id data", [("w1", "s1", '{"a": 1}'), ("w1", "s1", '{"a": null, "b": "ü"}')]),
    "webhook_deliveries": values("hook event_type n", [("all", "entity.created", 2), ("all", "ingestion.complete", 1), ("entities", "entity.created", 2)], {"n": "BIGINT"}),
    "graph_upsert_normal": values("raw normalized_value", [(" Blue Gull ", "blue gull"), ("ÀB", "àb"), ("", "")]),
}
