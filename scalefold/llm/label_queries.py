"""Queries that learn from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.llm import toxicity
from scalefold.llm.registry import register
from scalefold.llm.text import id_remainder, table

TOXIC_FOLDS, TOXIC_FOLD = 5, 0


@register()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", TOXIC_FOLDS) == TOXIC_FOLD
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    lexicon = toxicity.learn(toxicity.sampled(documents.filter(~held_out), labels))
    out = toxicity.score(documents.select("doc_id", "text", held_out.alias("held_out")), lexicon, carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
