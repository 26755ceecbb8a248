"""Registered queries over the given tables."""

from paywarden.plans import annex_queries, controls, explore_queries, source_queries  # noqa: F401
from paywarden.plans.registry import ORACLES, QUERIES  # noqa: F401
