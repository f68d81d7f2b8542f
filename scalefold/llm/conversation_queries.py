"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.llm import conversations
from scalefold.llm.registry import register
from scalefold.llm.text import table

DAMAGES = 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the remainder of a checksum of conversation and turn puts in; nulls are one space."""

    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % DAMAGES
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(kind == 4, "user").otherwise(known("role"))
    copies = F.when(kind == 3, 2).otherwise(1)
    left = rows.filter(kind != 0)
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


@register()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    made = conversations.repairs(damaged(rows))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        rows.select(F.col("conv_id").alias("_id")).distinct()
        .join(made, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
        .select(
            F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
        )
    )
