"""Queries that score ``documents`` with a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.llm import lm
from scalefold.llm.registry import register
from scalefold.llm.text import id_remainder, table

MODEL_FOLDS, MODEL_FOLD = 7, 2


@register()
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", MODEL_FOLDS) == MODEL_FOLD
    return lm.score(documents.withColumn("held_out", held_out), ~F.col("held_out"), carry=["doc_id", "held_out"])
