"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import calls, compare, detectors, evidence, graph, growth, messages, observed, rollouts, streams, text, trees, usage, windows  # noqa: F401  they register on import
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
