"""All registered queries."""

from landshift.plans import q_analysis, q_jobs, q_sources  # noqa: F401
from landshift.plans.registry import QUERIES

__all__ = ["QUERIES"]
