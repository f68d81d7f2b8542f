"""Sources that give samples: landed tables, column subsets, hex payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.functions.draws import draw_key, gaussian
from scalefold.operators.indexing import TASK_ROWS, dense_index
from scalefold.operators.sampling import SEED

# Bits per hex character, jitter of the bit source.
BITS = 4
JITTER = 1e-6
# Characters of a payload that are worked on as one text: a character is found by counting from its start.
PIECE = 256


def hex_bits(df: DataFrame, column: str, order: Sequence[str], series: str | None = None) -> DataFrame:
    """S8. Hex payloads as one bit stream per series, most significant bit first.

    Payloads of any length follow each other in ``order``; the stream position
    of a payload is the sum of the lengths before it, found on the payload rows
    and not on the bits.
    """
    keyed = df.withColumn("series_id", F.lit("bits") if series is None else F.col(series))
    payloads = dense_index(keyed, ["series_id"], order, "payload").select(
        "series_id", "payload", F.lower(column).alias("_hex")
    )
    starts = payload_starts(payloads)
    return spread_bits(payloads.join(starts, ["series_id", "payload"]))


def spread_bits(placed: DataFrame) -> DataFrame:
    """The bits of payloads ``(series_id, _start, _hex)``, of which ``_start`` characters of the series come before."""
    char = F.conv(F.substring("_hex", F.col("_c") + 1, F.lit(1)), 16, 10).cast("int")
    pieces = F.when(F.length("_hex") <= PIECE, F.array("_hex")).otherwise(
        F.regexp_extract_all("_hex", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    )
    chars = (
        placed.filter(F.length("_hex") > 0)  # sequence() would count down for an empty payload
        .select("series_id", "_start", F.posexplode(pieces).alias("_p", "_hex"))
        .withColumn("_start", F.col("_start") + PIECE * F.col("_p"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.length("_hex") - 1)))
        .select("series_id", (BITS * (F.col("_start") + F.col("_c"))).alias("_at"), char.alias("_v"))
    )
    bits = F.array(*[F.getbit("_v", F.lit(BITS - 1 - b)) for b in range(BITS)])
    return chars.select("series_id", "_at", F.posexplode(bits).alias("_b", "_bit")).select(
        "series_id", (F.col("_at") + F.col("_b")).alias("idx"), F.col("_bit").cast("double").alias("value")
    )


# Payloads per block of the running total.
START_BLOCK = 100_000


def payload_starts(payloads: DataFrame) -> DataFrame:
    """Characters before each payload: totals per block of payloads, then within the block."""
    from pyspark.sql import Window

    sized = payloads.select(
        "series_id", "payload", F.coalesce(F.length("_hex"), F.lit(0)).alias("_n"), F.expr(f"payload div {START_BLOCK}").alias("_block")
    )
    before = Window.partitionBy("series_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        sized.groupBy("series_id", "_block")
        .agg(F.sum("_n").alias("_total"))
        .select("series_id", "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy("series_id", "_block").orderBy("payload").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("_inner", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(blocks, ["series_id", "_block"])
        .select("series_id", "payload", (F.col("_base") + F.col("_inner")).alias("_start"))
    )


def jitter(df: DataFrame, sigma: float = JITTER, seed: int = SEED) -> DataFrame:
    """S9. Add a small keyed normal draw to every sample."""
    return df.withColumn("value", F.col("value") + sigma * gaussian(draw_key(seed, "jitter", "series_id", "idx")))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON document per line, with their hex text in ``qrn``."""
    return spark.read.schema("qrn string").json(path).filter(F.col("qrn").isNotNull())


def read_columns(
    spark: SparkSession, path: str, columns: Sequence[str], series_id: str, order: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """S11. Some numeric columns of a wide table as channels of one series; only those are scanned."""
    wide = spark.read.parquet(path).select(order, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    rows = dense_index(wide.withColumn("series_id", F.lit(series_id)), ["series_id"], [order], task_rows=task_rows)
    values = F.array(*[F.col(f"`{c}`") for c in columns])
    return rows.select("series_id", "idx", F.posexplode(values).alias("channel", "value")).select(
        "series_id", "channel", "idx", "value"
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """S12. A landed long table of samples."""
    return spark.read.schema("series_id string, idx bigint, value double").parquet(path)


def enabled(catalog: DataFrame) -> DataFrame:
    """S10. Datasets that are switched on."""
    return catalog.filter("enabled")


def zip_listings(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], pad: bool = False, task_rows: int = TASK_ROWS
) -> DataFrame:
    """J5. Pair two lists by position: the first of one with the first of the other, in ``pos`` from 0.

    Positions are made here: rows are put in the given order, ties by all other columns, so reruns pair alike; rows that
    are equal in everything stay neighbours. The longer list loses its end, or with ``pad`` meets NULLs. NULLs come first. The lists share no column.
    """

    def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in order]
        keyed = dense_index(df.withColumn("_list", F.lit(0)), ["_list"], [*order, *rest], "pos", task_rows)
        return keyed.drop("_list")

    return placed(left, left_order).join(placed(right, right_order), "pos", "full" if pad else "inner")
