"""Registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from tessera.queries import auditing, importing, operations, publishing, structure, text_rules  # noqa: F401  registers its queries
from tessera.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
