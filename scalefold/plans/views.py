"""Series views on the given tables: ``samples(series_id, [channel], idx, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.operators.indexing import dense_index

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ordered(df: DataFrame, order: list[str], *keep: str) -> DataFrame:
    return dense_index(df, ["series_id"], order).select("series_id", "idx", *keep)


def ev_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return _ordered(df, ["ts", "event_id"], "value")


def ev_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("series_id"), "ts", "event_id", "value"
    )
    return _ordered(df, ["ts", "event_id"], "value")


def li_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("series_id"),
        *LINE_ORDER,
        F.col("l_extendedprice").alias("value"),
    )
    return _ordered(df, LINE_ORDER, "value")


def li_supp_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        *LINE_ORDER,
        "l_extendedprice",
        "l_quantity",
        "l_discount",
    )
    return _ordered(df, LINE_ORDER, "l_extendedprice", "l_quantity", "l_discount")


def li_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel 0 of the supplier series."""
    return li_supp_wide(spark, sf_dir).select("series_id", "idx", F.col("l_extendedprice").alias("value"))


def li_supp_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels in long form."""
    wide = li_supp_wide(spark, sf_dir)
    values = F.array("l_extendedprice", "l_quantity", "l_discount")
    return wide.select("series_id", F.posexplode(values).alias("channel", "value"), "idx").select(
        "series_id", "channel", "idx", "value"
    )


def ord_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer, about ten: some series are too short for a subset."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("series_id"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("value")
    )
    return _ordered(df, ["o_orderdate", "o_orderkey"], "value")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select(
        F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("idx", "value")
    ).select("series_id", F.col("idx").cast("bigint"), F.col("value").cast("double"))


# Event types as five channels of one series, in alphabetical order.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def ev_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return ev_type(spark, sf_dir).select(
        F.lit("events").alias("series_id"),
        (F.array_position(kinds, F.col("series_id")) - 1).cast("int").alias("channel"),
        "idx",
        "value",
    )
