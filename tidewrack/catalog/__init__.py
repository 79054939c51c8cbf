"""Every operator as a runnable query over the test tables, with its SQL counterpart."""

from __future__ import annotations

from tidewrack.catalog import (  # noqa: F401  (importing registers the queries)
    coverage,
    effort,
    expressions,
    history,
    landed,
    live,
    merging,
    risk,
    serving,
    spatial,
)
from tidewrack.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
