"""Queries over ``documents`` whose operators are stages of the corpus pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.llm import binary, decontaminate, language, mixing, simhash
from scalefold.llm.registry import register
from scalefold.llm.text import id_remainder, table
from scalefold.session import run_dir

MIX_CYCLE = (5.0, 2.0, 1.0)
MIX_CAP = 3
FINGERPRINT_WORDS = 4
FINGERPRINT_BITS = 4
LANGUAGE_FOLDS, LANGUAGE_FOLD = 3, 1
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


@register()
def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    weights = mixing.cycled_weights(documents, "source", MIX_CYCLE)
    out = mixing.mix(documents, weights, cap=MIX_CAP, carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@register(
    r"""
with lowered as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
windows as (
  select distinct item_id, least(len(w), 10) as k,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0)),
places as (
  select r, w, k, unnest(range(1, len(w) - k + 2)) as i
  from lowered, (select distinct k from windows) where len(w) >= k),
found as (
  select p.r, p.i, p.k, x.item_id
  from places p join windows x on x.k = p.k and x.s = array_to_string(list_slice(p.w, p.i, p.i + p.k - 1), ' ')),
hits as (select r, count(distinct j) as n from (select r, unnest(range(i, i + k)) as j from found) group by r),
named as (
  select r, count(*) as n, string_agg(id, ',' order by id) as ids
  from (select distinct r, cast(item_id as varchar) as id from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(m.n, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from lowered l left join hits h using (r) left join named m using (r)
"""
)
def op4_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items.item", ","), 256).alias("items_sha256"), "contaminated",
    )


@register()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(
        table(spark, sf_dir, "documents"), words_per_shingle=FINGERPRINT_WORDS, most=FINGERPRINT_BITS
    )
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", LANGUAGE_FOLDS) == LANGUAGE_FOLD
    model = language.fit(documents.filter(~held_out))
    out = language.identify(documents.select("doc_id", "text", held_out.alias("held_out")), model,
                            carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_spans")


@register()
def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_dir(spark)}/ids-{uuid.uuid4().hex}"
    binary.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file(), END_ID)
    return binary.read_checksums(spark, path)
