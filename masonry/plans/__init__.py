"""Named queries over the driver's tables, with the SQL they are held against."""

from __future__ import annotations

from . import assembly, cells, evidence, geometry, metadata, portfolio, reconcile  # noqa: F401  the others add their queries to those of portfolio


def queries() -> dict:
    return dict(portfolio.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(portfolio.ORACLES)
