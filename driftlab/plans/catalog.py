"""All registered queries and their SQL."""

from __future__ import annotations

from driftlab.plans import checks, corpus, fits, live, reports, robustness, selection, stores, streams

_PARTS = (robustness, corpus, streams, reports, selection, stores, fits, live, checks)


def queries() -> dict:
    return {k: v for m in _PARTS for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _PARTS for k, v in m.SQL.items()}
