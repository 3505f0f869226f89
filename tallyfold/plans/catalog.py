"""All queries of the engine's own operators."""

from __future__ import annotations

from . import consensus, cookbook, desk, filings, finding, linking, marts, relational, resolution, scalars, search, turnover, workspace  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
