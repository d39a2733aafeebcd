"""All registered queries."""

from workload import queries_bars, queries_research, queries_universe  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
