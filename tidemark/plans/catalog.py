"""All queries of the engine and their DuckDB SQL."""

from tidemark.plans import analysis, levels, market, reports, rules, streamed  # noqa: F401  they register their queries
from tidemark.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
