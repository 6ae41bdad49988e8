"""Registered queries bound to the test tables, with their check SQL."""

from seriesloom.plans import clean_plans, cluster_plans, diagnostic_plans, evaluation_plans, feature_plans, model_plans, relational_plans, source_plans  # noqa: F401
from seriesloom.plans.registry import CHECKS, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
