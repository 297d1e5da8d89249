"""Runnable queries over the derived views, one per operator."""
from .registry import ORACLES, QUERIES
from . import curation_queries, exchange_queries, join_queries, mask_queries, review_queries, seam_queries, summary_queries, tiling_queries, training_queries  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
