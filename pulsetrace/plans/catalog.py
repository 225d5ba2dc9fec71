"""All registered queries in one place."""

from __future__ import annotations

from pulsetrace.plans import (  # noqa: F401
    closed_form_queries, enrichment_queries, feature_queries, flow_queries, model_queries, score_queries, sweep_queries,
)
from pulsetrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
