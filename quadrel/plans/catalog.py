"""Queries of the video engine by name, with SQL oracles."""

from __future__ import annotations

from . import bit_queries, block_queries, catalogue_queries, decode_queries, format_queries, header_queries, motion_queries

_PARTS = (header_queries, bit_queries, block_queries, motion_queries, format_queries, catalogue_queries, decode_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
