"""Views over the input tables and the query catalogue."""

from tradewake.plans import (  # noqa: F401
    aggregate_queries,
    evaluation_queries,
    model_queries,
    relation_queries,
    sampling_queries,
    scalar_queries,
    segment_queries,
    source_queries,
    stream_queries,
    window_queries,
)
from tradewake.plans.catalog import CATALOG, run

__all__ = ["CATALOG", "run"]
