"""Text sources: dirty CSV, positional TSV, whitespace tables, key/value files, file listings.

Lines are put in file order by (file, block start, place in the block): a
block is read by one task from its start, so the pair orders all lines of a
file however many tasks read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scalefold.config import ASTROMETRY_COLUMNS, ASTROMETRY_SKIP, PULSAR_DATE
from scalefold.functions.numeric import NA_TOKENS, null_tokens, parse_number
from scalefold.operators.indexing import TASK_ROWS, dense_index

# Words that mark a noise line, and the date part of a timing file's name.
NOISE_WORDS = ["EFAC", "EQUAD", "ECORR"]
DATE_PATTERN = r"_PINT_(.*?)\.nb\.tim"


def read_dirty_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    comment: str | None = "#",
) -> DataFrame:
    """S1, S1b. All columns as strings; null tokens become NULL, lines with too many fields are left out.

    The schema has one more column than the file: a line that fills it is
    malformed. Short lines end in NULLs. ``columns`` defaults to the header.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    names = list(columns) if columns is not None else reader.csv(paths[0]).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_extra"]])
    raw = reader.schema(schema).csv(paths)
    fields = [null_tokens(F.col(f"`{c}`"), list(na_tokens)).alias(c) for c in names]
    return raw.filter(F.col("_extra").isNull()).select(*fields, F.col("_metadata.file_path").alias("file"))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files with ``file`` and an order ``(_start, _line)`` within the file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )


def read_positional_tsv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: dict[str, int] = ASTROMETRY_COLUMNS,
    skip: int = ASTROMETRY_SKIP,
    rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """S2. Rows ``skip + 1 ...`` of headerless files, by field position; all of them, or the first ``rows`` per file.

    Lines with more fields than the first data line are skipped. The ranks that
    look for the first line, and for the first ``rows``, are top-k: each task passes on
    no more than that many lines of a file. ASTROMETRY_ROWS is the published limit.
    """
    lines = read_lines(spark, path)
    order = Window.partitionBy("file").orderBy("_start", "_line")
    width = F.size(F.split("value", "\t", -1))
    first = (
        lines.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= skip + 1)
        .filter(F.col("_r") == skip + 1)
        .select("file", F.struct("_start", "_line").alias("_first"), width.alias("_width"))
    )
    data = lines.join(first, "file").filter((F.struct("_start", "_line") >= F.col("_first")) & (width <= F.col("_width")))
    cut = F.split("value", "\t", -1)
    if rows is None:
        numbered = dense_index(data, ["file"], ["_start", "_line"], "row", task_rows)
    else:
        numbered = data.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows)
        numbered = numbered.withColumn("row", F.col("_r") - 1)
    return numbered.select(
        "file",
        F.col("row").cast("bigint"),
        *[parse_number(F.get(cut, F.lit(p))).alias(name) for name, p in columns.items()],
    )


def read_whitespace_column(
    spark: SparkSession, path: str | Sequence[str], position: int = 1, task_rows: int = TASK_ROWS
) -> DataFrame:
    """S3. One numeric field of whitespace-separated files, ``(file, idx, value)``; comments and non-numbers dropped."""
    bare = F.trim(F.regexp_replace("value", "#.*$", ""))
    field = F.get(F.split(bare, r"\s+"), F.lit(position))
    values = (
        read_lines(spark, path)
        .filter(bare != "")
        .select("file", "_start", "_line", parse_number(field).alias("value"))
        .filter(F.col("value").isNotNull())
    )
    return dense_index(values, ["file"], ["_start", "_line"], task_rows=task_rows).select("file", "idx", "value")


def read_first_match(spark: SparkSession, path: str | Sequence[str], words: Sequence[str] = NOISE_WORDS) -> DataFrame:
    """S4. Second token of the first line that holds one of the words, per file."""
    token = F.get(F.split(F.trim("value"), r"\s+"), F.lit(1))
    return (
        read_lines(spark, path)
        .filter(F.col("value").rlike("|".join(words)))
        .groupBy("file")
        .agg(F.min_by(token, F.struct("_start", "_line")).alias("_token"))
        .select("file", parse_number(F.col("_token")).alias("value"))
    )


def first_available(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """S5. Per key the rows of the first source that has any, with that source's ``priority``."""
    rows = None
    for priority, df in enumerate(sources):
        part = df.withColumn("priority", F.lit(priority))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return rows.join(best, [*keys, "priority"], "left_semi").select(rows.columns)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """S6. Paths below ``path`` whose name matches ``pattern``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    )


def name_part(name: Column, pattern: str = DATE_PATTERN, default: str = PULSAR_DATE) -> Column:
    """S6. First group of ``pattern`` in a file name, or the default."""
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found).otherwise(F.lit(default))


def file_dates(names: DataFrame, files: DataFrame, default: str = PULSAR_DATE) -> DataFrame:
    """S6. Date in the timing file of each ``names(series_id)``; the default where there is none."""
    found = files.withColumn("series_id", F.regexp_extract("name", r"^(.*?)_PINT_", 1)).groupBy("series_id").agg(
        F.min("name").alias("name")
    )
    return names.join(found, "series_id", "left").select(
        "series_id", name_part(F.coalesce("name", F.lit("")), default=default).alias("date")
    )


def existing(config: DataFrame, files: DataFrame, column: str = "name") -> DataFrame:
    """S7. Datasets whose file is there."""
    return config.join(files.select(column), column, "left_semi")
