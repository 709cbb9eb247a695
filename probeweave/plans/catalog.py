"""Imports every query module, so that all queries are registered."""

from probeweave.plans import queries_abolish, queries_chambers, queries_clean, queries_features, queries_replicates, queries_scan, queries_sites, queries_sources, queries_training  # noqa: F401
from probeweave.plans.registry import QUERIES, SQL  # noqa: F401
