"""Registered queries and the ANSI SQL each is held against."""

from __future__ import annotations

from biblioflow.plans import exchange, files, graphs, records

QUERIES = {**records.QUERIES, **graphs.QUERIES, **exchange.QUERIES, **files.QUERIES}
ORACLE_SQL = {**records.ORACLE_SQL, **graphs.ORACLE_SQL, **exchange.ORACLE_SQL, **files.ORACLE_SQL}
