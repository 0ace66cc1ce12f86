"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from quireflow.plans import checks, contracts, files, layout, origins, readers, structure, text  # noqa: F401  they register themselves
from quireflow.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
