"""Importing this module registers every query."""

from pairloom.plans import q_builders, q_metrics, q_pairs, q_sampling, q_sources, q_text, q_variants, q_vectors  # noqa: F401
from pairloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
