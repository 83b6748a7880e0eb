"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from lexmill.plans.oracles import ORACLE_SQL
from lexmill.plans.reference_queries import QUERIES

FLAGSHIP = QUERIES["boosted_topk"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
