"""Registered queries and their SQL, by part of the engine."""

from . import causal, requests, timeseries

PARTS = (timeseries, causal, requests)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}

if len(QUERIES) != sum(len(part.QUERIES) for part in PARTS):
    raise RuntimeError("two queries share a name")
