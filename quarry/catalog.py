"""Named queries over the standard tables, each with its SQL oracle."""

from __future__ import annotations

from .plans import graph_queries, operator_queries, row_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES, WITHOUT_SQL  # noqa: F401
