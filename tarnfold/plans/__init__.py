"""All registered queries."""

from __future__ import annotations

from tarnfold.plans import (  # noqa: F401
    ensemble_queries,
    feature_queries,
    geo_queries,
    metric_queries,
    model_queries,
    stats_queries,
    store_queries,
    text_queries,
)
from tarnfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
