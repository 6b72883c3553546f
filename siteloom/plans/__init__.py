"""Registered queries, one module per operator family."""

from siteloom.plans import condense_queries, crawl_queries, extract_queries, finding_queries, lifecycle_queries, link_queries, migrate_queries, model_queries, stream_queries, task_queries  # noqa: F401
from siteloom.plans.registry import REGISTRY  # noqa: F401
