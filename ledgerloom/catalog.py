"""All queries of the library but those of the subpackage llm."""

from __future__ import annotations

from .operators import analytics, audit, extraction, fiscal, identity, lifecycle, matching, ordering, receipts, scalars, storage  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES
from .sources import queries as _sources  # noqa: F401
from .streaming import audit_log, sessions  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
