"""Where queries and their DuckDB twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.functions.numeric import round6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SERIES = ("series_id",)
SCALES = [2, 4, 8, 16, 32, 64, 128]


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE[query.__name__] = sql
        return query

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round6(F.col(n)) for n in names})
