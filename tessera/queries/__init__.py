"""Registered queries over the driver's tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from tessera.queries import conversations, retrieval, star, streams, tables

QUERIES = retrieval.QUERIES | conversations.QUERIES | tables.QUERIES | streams.QUERIES | star.QUERIES
ORACLES = retrieval.ORACLES | conversations.ORACLES | tables.ORACLES | streams.ORACLES | star.ORACLES
