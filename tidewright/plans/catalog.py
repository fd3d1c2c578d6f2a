"""All queries by name, and the SQL each is checked against."""

from __future__ import annotations

from . import delivery, entities, extensions, governance, ingest, network, problems, records

MODULES = (entities, records, governance, network, ingest, delivery, extensions, problems)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
#: The flagship query.
flagship = entities.entity_threat_summary
