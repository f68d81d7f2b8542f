"""Queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.llm import covertree, topk
from scalefold.llm.registry import register
from scalefold.llm.text import table

SCALE = 64.0
QUERY_EVERY = 20
BEST = 20

NEGATIVE_SCALE = 256.0
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
NEGATIVES = 5
LOW, HIGH = 80, 100


@register(
    f"""
with v as (
  select vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as w
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum([z[1] * z[2] for z in list_zip(q.w, c.w)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.w) = len(c.w) where q.vec_id % {QUERY_EVERY} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {BEST}
"""
)
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding", SCALE).alias("vec"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), k=BEST)


@register(
    f"""
with v as (
  select vec_id, case when vec_id % {SHIFT_EVERY} = 0 then (label + 1) % {LABELS} else label end as label,
         [cast(floor({NEGATIVE_SCALE} * cast(x as double)) as bigint) for x in embedding] as w
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
a as (
  select *, row_number() over () as n
  from (select distinct vec_id as anchor_id, label as own_label, w as own_w from v where vec_id % {ANCHOR_EVERY} = 0)),
s as (
  select a.n, a.anchor_id, a.own_label, c.vec_id, c.label,
         cast(list_sum([z[1] * z[2] for z in list_zip(a.own_w, c.w)]) as bigint) as score
  from a join v c on a.anchor_id <> c.vec_id and len(a.own_w) = len(c.w)),
p as (
  select *, row_number() over (partition by n order by score desc, vec_id) as r
  from s where label = own_label qualify r <= {NEGATIVES}),
g as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.n, p.r order by s.score desc, s.vec_id) as rank
  from p join s on s.n = p.n and s.label <> p.own_label
    and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from g where rank <= {NEGATIVES}
"""
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", shifted.alias("label"), topk.quantised("embedding", NEGATIVE_SCALE).alias("vec")
    )
    anchors = vectors.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    return covertree.hard_negatives(vectors, anchors, k=NEGATIVES, low=LOW, high=HIGH)
