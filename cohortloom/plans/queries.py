"""All registered queries."""

from cohortloom.plans import (  # noqa: F401
    atlas_queries,
    cohort_queries,
    encoding_queries,
    hierarchy_queries,
    model_queries,
    prediction_queries,
    stats_queries,
    subtype_queries,
    temporal_queries,
)
from cohortloom.plans.catalog import REGISTRY

__all__ = ["REGISTRY"]
