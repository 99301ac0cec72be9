"""All record queries and their SQL."""

from __future__ import annotations

from . import oracles, outputs, queries, service

QUERIES = queries.QUERIES | service.QUERIES | outputs.QUERIES
ORACLE = oracles.ORACLE | service.oracles(oracles.sql) | outputs.oracles(oracles.sql)
