"""Queries by name; importing this package registers them."""

from heddle.plans import evaluate_queries, harmonize_queries, layer_queries, search_queries, source_queries, workload_queries  # noqa: F401
