"""All checked queries."""

from lendframe.plans.registry import QUERIES, SQL
from lendframe.plans import catalog_rules, catalog_eda, catalog_prep, catalog_validate, catalog_features, catalog_duplicates, catalog_metrics, catalog_models, catalog_neighbours, catalog_flows  # noqa: F401

__all__ = ["QUERIES", "SQL"]
