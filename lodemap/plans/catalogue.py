"""All queries of the library and their oracles."""

from __future__ import annotations

from . import clouds, composed, extras, instances  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
