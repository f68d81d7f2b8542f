"""The corpus pipeline: from raw documents to compressed token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; its
result is written as Parquet and read again for the next. All but the last return
the columns of ``documents``.

The language model is fitted to the non-null ``lang`` of its own input, over all rows.
A stage keeps the rows it does not reject as they are; null texts have no letter, so
language ID rejects them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.llm import binary, decontaminate, language, mixing, simhash
from scalefold.llm import corpus_queries as q
from scalefold.llm.text import table
from scalefold.session import land, run_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter are rejected; all others have a language, if any was learned."""
    model = language.fit(docs)
    if not model.languages:
        return language.lettered(docs)
    return language.identify(docs, model).filter(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return simhash.keep_one(docs, words_per_shingle=q.FINGERPRINT_WORDS, most=q.FINGERPRINT_BITS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item are removed."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), carry=[*docs.columns])
    return found.filter(~F.col("contaminated")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it. Its own values decide the draw; ``_row`` only joins copies back."""
    drawn = F.xxhash64(*docs.columns, *(F.isnull(c) for c in docs.columns))
    rows = land(docs.withColumns({"_row": F.monotonically_increasing_id(), "_drawn": drawn}), "rows")
    weights = mixing.cycled_weights(rows, "source", q.MIX_CYCLE)
    copies = mixing.mix(rows, weights, id_col="_drawn", cap=q.MIX_CAP, carry=["_row"]).select("_row", "copies")
    taken = rows.join(copies.filter("copies > 0"), "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as files of token ids, one row for every document read back from them."""
    path = f"{run_dir(spark)}/ids-{uuid.uuid4().hex}"
    binary.write_ids(docs, path, q.tokenizer_file(), q.END_ID)
    return binary.read_checksums(spark, path)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_ids),
]

#: Language ID, fingerprints, Newton steps and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
