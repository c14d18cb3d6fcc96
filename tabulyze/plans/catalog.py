"""Importing this module registers every query."""

from tabulyze.plans import analysis_queries, decision_queries, prepare_queries, profile_queries  # noqa: F401
from tabulyze.plans.registry import OPERATORS, ORACLES, QUERIES  # noqa: F401
