"""All registered queries of the search engine, and their SQL."""

from __future__ import annotations

from termloom.queries import bag_queries, index_queries, search_queries
from termloom.queries.base import Query

QUERIES: dict[str, Query] = bag_queries.QUERIES | index_queries.QUERIES | search_queries.QUERIES
ORACLES: dict[str, str] = bag_queries.ORACLES | index_queries.ORACLES | search_queries.ORACLES
