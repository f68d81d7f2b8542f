"""Queries that remove what repeats inside ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scalefold.llm import lines, repeats
from scalefold.llm.registry import register
from scalefold.llm.text import table


@register()
def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register()
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256")
