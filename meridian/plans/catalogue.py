"""The registered queries of the engine, and the SQL each is checked against."""

from __future__ import annotations

from meridian.plans import kernel_queries, search_queries, voyage_queries, wind_queries

QUERIES: dict = {}
ORACLES: dict = {}
for part in (voyage_queries, wind_queries, search_queries, kernel_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
