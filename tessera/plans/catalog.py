"""The registered queries over the reference's operators, each with its SQL."""

from __future__ import annotations

from tessera.plans import changes, crawl, feed, ingest, library, scalars

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (feed, library, ingest, crawl, changes, scalars):
    QUERIES |= _plans.QUERIES
    ORACLE_SQL |= _plans.ORACLE_SQL
