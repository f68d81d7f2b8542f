"""Payload files that keep arriving (the polling side of S8).

Each response lands as a JSON file of its own. A call takes in the files that
are new since the last one and stops; the checkpoint remembers which were read.
``land_payloads`` keeps the payloads, ``stream_bits`` carries on the bit stream of each series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scalefold.sources.series import spread_bits

#: Files a micro-batch takes in: what one task may hold of a series. More files make more micro-batches.
BATCH_FILES = 256
BIT_ROWS = "series_id string, idx bigint, value double"


def land_payloads(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Append new hex payloads to a Parquet table, with the columns ``(arrived, file)`` that order them."""
    arrived = (
        spark.readStream.schema("qrn string")
        .json(source)
        .filter(F.col("qrn").isNotNull())
        .select(
            "qrn",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("arrived"),
        )
    )
    query = (
        arrived.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()


def place_payloads(arrived: DataFrame, order: Sequence[str]) -> DataFrame:
    """Characters of a series before each of its rows ``(series_id, _hex, *order)`` as ``_start``, counted on from batch to batch.

    The state of a series is one number. Rows of a micro-batch follow each other in ``order``, behind everything placed
    before: a row that comes late never moves bits that were already given out.
    """

    def place(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (start,) = state.get if state.exists else (0,)
        rows = pd.concat(list(chunks)).sort_values(list(order), kind="stable")
        sizes = rows["_hex"].str.len()
        state.update((start + int(sizes.sum()),))
        yield pd.DataFrame({"series_id": key[0], "_start": start + sizes.cumsum() - sizes, "_hex": rows["_hex"]})

    return arrived.groupBy("series_id").applyInPandasWithState(
        place, "series_id string, _start bigint, _hex string", "chars bigint", "append", GroupStateTimeout.NoTimeout
    )


def stream_bits(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    series: str | None = None,
    order: Sequence[str] = ("arrived", "file"),
    batch_files: int = BATCH_FILES,
) -> DataFrame:
    """S8 over files that keep arriving: append the bits of new files to ``target`` and return all bits so far.

    A file holds JSON lines with hex text in ``qrn``, which follow each other; ``series`` names a field that tells whose they
    are (null: none of them is read), else all are of series ``bits``. Files of a micro-batch are placed in ``order``, of the columns
    ``arrived`` (time of the file) and ``file`` (its path); a file that comes late goes behind those already read. A path counts once: a file
    written again under its name is not read again. Lines that are no JSON or have no ``qrn``, and empty files, give no bits. After a
    failure the next call takes up from the checkpoint and no bit is lost, moved or written twice.
    """
    line = f"qrn string, `{series}` string" if series else "qrn string"
    files = (
        spark.readStream.option("maxFilesPerTrigger", batch_files)
        .text(source, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))
    )
    said = F.transform(F.split("value", "\r?\n"), lambda x: F.from_json(x, line))
    owner = (lambda x: x[series]) if series else (lambda x: F.lit("bits"))
    said = F.filter(said, lambda x: x["qrn"].isNotNull() & owner(x).isNotNull())
    own = F.filter("said", lambda x: owner(x) == F.col("series_id"))
    payloads = (
        files.select(said.alias("said"), "file", "arrived")
        .withColumn("series_id", F.explode(F.array_distinct(F.transform("said", owner))))
        .select("series_id", "file", "arrived", F.lower(F.array_join(F.transform(own, lambda x: x["qrn"]), "")).alias("_hex"))
    )
    query = (
        spread_bits(place_payloads(payloads, order))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(BIT_ROWS).parquet(target)
