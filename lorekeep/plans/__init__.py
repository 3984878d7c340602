"""Registered queries over the reference's operators, with their DuckDB SQL."""

from __future__ import annotations

from . import episodes, graph, identity, kept, lifecycle, retrieval, service, texts  # noqa: F401  they register
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
