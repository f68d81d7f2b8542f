"""All registered queries: each reads whole tables and has a DuckDB twin where SQL can say it."""

from scalefold.plans import (  # noqa: F401
    clean_queries,
    core_queries,
    index_queries,
    sampling_queries,
    signal_queries,
    source_queries,
)
from scalefold.plans.core_queries import mfdfa_df
from scalefold.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "mfdfa_df"]
