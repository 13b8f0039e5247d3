"""Every query of the library by name, and the SQL that states what it returns."""

from __future__ import annotations

from collections.abc import Callable

from orrery.plans import analytics, relational, reports, study  # noqa: F401  (they register their queries)
from orrery.plans.registry import ORACLES, QUERIES

FLAGSHIP = "s0_labeled_windows"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
