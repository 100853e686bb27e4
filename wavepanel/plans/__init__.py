"""Runnable analyses: every operator and study on the driver tables, with its SQL counterpart."""

from wavepanel.plans import model_queries, study_queries, table_queries  # noqa: F401
from wavepanel.plans.registry import QUERIES

__all__ = ["QUERIES"]
