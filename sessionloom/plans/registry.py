"""All registered queries and their oracle SQL, by name."""

from __future__ import annotations

from . import attribution_queries, classification_queries, enrichment_queries, feature_queries, governance_queries, ingest_queries, readmodel_queries, sequence_queries  # noqa: F401
from .register import ORACLES, QUERIES

FLAGSHIP = "run_summary"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
