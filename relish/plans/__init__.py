"""All registered queries."""

from __future__ import annotations

from relish.plans import registry
from relish.plans import basic_queries, cluster_queries, dedup_queries, generation_queries, retrieval_queries, source_queries, store_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracles():
    return dict(registry.ORACLES)
