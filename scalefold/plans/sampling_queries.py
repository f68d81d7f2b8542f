"""Subset policy, windows, samples, sky discs and pair features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.config import FAMILIES, Family, family_config
from scalefold.functions.draws import draw_key, uniform
from scalefold.operators import packed as pk
from scalefold.operators import sampling as sa
from scalefold.operators.indexing import dense_index
from scalefold.plans import oracle as o
from scalefold.plans import run
from scalefold.plans import views as v
from scalefold.plans.clean_queries import all_lengths, all_lengths_chain
from scalefold.plans.registry import SCALES, register, rounded
from scalefold.session import land

LEDGER = Family("ledger", 250, 100, 1.19, 0.04, "unit_std", SCALES)


def ledger(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples of one family with their plan and windows."""
    samples = df.withColumn("family", F.lit(LEDGER.name))
    plan = sa.subset_plan(run.series_lengths(samples), family_config(spark, [LEDGER]))
    return samples, plan, sa.subset_windows(plan)


def ledger_measures(spark: SparkSession, df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan, windows and the ``columns`` of the measures that are read later."""
    samples, plan, windows = ledger(spark, df)
    return plan, windows, run.measure_subsets(samples, windows, plan, [LEDGER], columns=columns)


_SIZES = {f.name: (f.subset_size, f.n_subsets) for f in FAMILIES}


@register(
    all_lengths_chain().select(
        f"""select series_id, family, n,
        (case when family <> 'pulsar' and n < 1250 then greatest(30, least(125, floor(0.1::double * n)))
            else case family {' '.join(f"when '{f}' then {s}" for f, (s, _) in _SIZES.items())} end end)::int as size,
        (case when family <> 'pulsar' and n < 1250 then 75
            else case family {' '.join(f"when '{f}' then {k}" for f, (_, k) in _SIZES.items())} end end)::int as n_subsets,
        case when family = 'pulsar' then 'fixed-family' when n < 1250 then 'adaptive' else 'fixed' end as mode from lens where n >= 10"""
    )
)
def subset_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.subset_plan(all_lengths(spark, sf_dir), family_config(spark))


def _supp_subsets() -> o.Chain:
    return o.subset_ctes(o.Chain().view("li_supp"), "li_supp", LEDGER.subset_size, LEDGER.n_subsets)


@register(_supp_subsets().select("select series_id, subset_id, start, size from wins"))
def subset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, v.li_supp(spark, sf_dir))[2].drop("family")


@register(_supp_subsets().select("select series_id, subset_id, idx, value from subs"))
def subset_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, _, windows = ledger(spark, v.li_supp(spark, sf_dir))
    return sa.subset_samples(samples, windows).drop("family", "size")


@register(
    o.Chain().view("ev_user").select(
        f"""select series_id, pick::int as pick, idx, value from (select *, row_number() over
        (partition by series_id order by {o.uniform(o.key('sample', 'series_id', 'idx'))}, idx) - 1 as pick from ev_user) where pick < 20"""
    )
)
def sample_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = uniform(draw_key(sa.SEED, "sample", "series_id", "idx"))
    return sa.simple_sample(v.ev_user(spark, sf_dir), ["series_id"], 20, u, "idx")


@register(
    o.subset_measure_ctes(o.Chain().view("li_supp"), "li_supp", LEDGER.subset_size, LEDGER.n_subsets, SCALES).select(
        f"""select series_id, subset_id, start, size, {o.r6('d_f')} as d_f, {o.r6('mean_h')} as mean_h,
        coalesce(n_valid_q, 0) as n_valid_q, coalesce(n_scales_used, 0) as n_scales_used from res"""
    )
)
def subset_mfdfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, windows, measures = ledger_measures(spark, land(v.li_supp(spark, sf_dir), "series"), pk.SUMMARY)
    out = run.subset_results(measures, windows).drop("family").fillna(0, ["n_valid_q", "n_scales_used"])
    return rounded(out, "d_f", "mean_h")


def _written_subsets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows, and their denoised samples written as one row a window and read back."""
    samples, plan, windows = ledger(spark, land(v.li_supp(spark, sf_dir), "series"))
    return windows, land(run.pack_subsets(samples, windows, plan, [LEDGER]), "denoised")


@register(_supp_subsets().select(f"select series_id, subset_id, idx, {o.r9('value')} as value from den"))
def denoised_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of denoised subsets, as rows."""
    return pk.unpacked(_written_subsets(spark, sf_dir)[1]).select("series_id", "subset_id", "idx", F.round("value", 9).alias("value"))


@register(
    o.subset_measure_ctes(o.Chain().view("li_supp"), "li_supp", LEDGER.subset_size, LEDGER.n_subsets, SCALES).select(
        f"select series_id, subset_id, {o.r6('d_f')} as d_f, coalesce(n_scales_used, 0) as n_scales_used from res"
    )
)
def written_subsets_mfdfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is measured on the written subsets, which are read without a shuffle."""
    windows, packed = _written_subsets(spark, sf_dir)
    out = run.subset_results(pk.measure_packed(packed, columns=pk.SUMMARY), windows).fillna(0, ["n_scales_used"])
    return rounded(out.select("series_id", "subset_id", "d_f", "n_scales_used"), "d_f")


_LINES_SCALES_FAMILIES = [
    Family("short", 125, 100, 1.16, 0.04, "unit_std"),
    Family("fixed", 250, 100, 1.19, 0.04, "unit_std", SCALES),
]


def _mixed_sql() -> str:
    from scalefold.operators.grids import LINES_MAX, lines_scales

    rows = ", ".join(o.list_sql(lines_scales(4 * top)) for top in range(1, LINES_MAX + 1))
    c = o.Chain().view("ev_user").view("ev_type")
    c.add("src", "select 'u' || series_id as series_id, idx, value from ev_user union all select series_id, idx, value from ev_type")
    c.add("srclen", "select series_id, count(*) as n from src group by series_id")
    o.subset_ctes(c, "src", 250, 100)
    grid = f"""select e.series_id, e.subset_id, unnest(range(len(sc)))::int as scale_pos, unnest(sc) as s from every e join (
        select series_id, case when series_id like 'u%' then ([{rows}])[least(n // 4, 500)::int] else {o.list_sql(SCALES)} end as sc
        from srclen) g on e.series_id = g.series_id"""
    o.measure_ctes(c, "den", "series_id, subset_id", grid)
    return c.select(f"""select w.series_id, w.subset_id, {o.r6('d_f')} as d_f, coalesce(n_scales_used, 0) as n_scales_used from wins w left join
        (select series_id, subset_id, avg(alpha) as d_f, max(n_scales) as n_scales_used from spec group by series_id, subset_id) d
        on w.series_id = d.series_id and w.subset_id = d.subset_id""")


@register(_mixed_sql())
def subset_mfdfa_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with a grid by series length and with a fixed one, in one job."""
    users = v.ev_user(spark, sf_dir).withColumn("series_id", F.concat(F.lit("u"), "series_id"))
    samples = users.withColumn("family", F.lit("short")).unionByName(
        v.ev_type(spark, sf_dir).withColumn("family", F.lit("fixed"))
    )
    samples = land(samples, "series")
    plan = sa.subset_plan(run.series_lengths(samples), family_config(spark, _LINES_SCALES_FAMILIES))
    windows = sa.subset_windows(plan)
    measures = run.measure_subsets(samples, windows, plan, _LINES_SCALES_FAMILIES, columns=pk.SUMMARY)
    out = run.subset_results(measures, windows).select("series_id", "subset_id", "d_f", "n_scales_used")
    return rounded(out.fillna(0, ["n_scales_used"]), "d_f")


# --- sky --------------------------------------------------------------------

_SKY = """select 'sky' as series_id, vec_id as pixel, row_number() over (order by vec_id) - 1 as idx,
    x / r as x, y / r as y, z / r as z, value, acos(greatest(least(z / r, 1), -1)) as theta from (
    select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as value,
    sqrt(embedding[1]::double * embedding[1]::double + embedding[2]::double * embedding[2]::double
        + embedding[3]::double * embedding[3]::double) as r from embeddings) where r > 0"""


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points of the sphere: the first three coordinates set to unit length."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    raw = v.table(spark, sf_dir, "embeddings").select(
        F.lit("sky").alias("series_id"), F.col("vec_id").alias("pixel"), e[0].alias("a"), e[1].alias("b"), e[2].alias("c"), e[3].alias("value")
    )
    r = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    unit = raw.withColumn("r", r).filter("r > 0").selectExpr("series_id", "pixel", "a / r as x", "b / r as y", "c / r as z", "value")
    theta = F.acos(F.greatest(F.least("z", F.lit(1.0)), F.lit(-1.0)))
    return dense_index(unit.withColumn("theta", theta), ["series_id"], ["pixel"])


@register(
    f"""with sky as ({_SKY}) select pixel, {o.r6('theta')} as theta, value from sky
    where theta < radians(60) or theta > radians(120)"""
)
def strip_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sa.strip_mask(sky(spark, sf_dir)).select("pixel", "theta", "value"), "theta")


DISC_SUBSETS, DISC_SIZE, DISC_STD = 20, 25, 0.08
DISC_ANGLE = math.radians(30)


def _disc_sql() -> str:
    c = o.Chain().add("sky", _SKY).add("subsets", f"select unnest(range({DISC_SUBSETS}))::int as subset_id")
    c.add("centres", "select 'sky' as series_id, subset_id from subsets")
    c.add("place", f"select subset_id, floor({o.uniform(o.key('centre', 'series_id', 'subset_id'))} * (select count(*) from sky))::bigint as idx from centres")
    c.add("spot", "select subset_id, x, y, z from place join sky using (idx)")
    c.add("inside", f"""select subset_id, series_id, pixel, value from sky s join spot c
        on s.x * c.x + s.y * c.y + s.z * c.z >= cos({DISC_ANGLE!r}::double)""")
    c.add("ranked", f"""select *, row_number() over (partition by subset_id
        order by {o.uniform(o.key('disc', 'series_id', 'subset_id', 'pixel'))}, pixel) - 1 as pick from inside""")
    c.add("few", f"select * from ranked where pick < {DISC_SIZE}")
    c.add("good", f"select subset_id from few group by subset_id having count(*) = {DISC_SIZE} and stddev_pop(value) >= {DISC_STD}")
    c.add("picks", f"""select 'sky' as series_id, subset_id, n, unnest(range(least({DISC_SIZE}, n)))::bigint as pick
        from subsets, (select count(*) as n from sky) where subset_id not in (from good)""")
    c.add("begin", "select *, pick as place from picks")
    o.permuted_ctes(c, "begin", "n", "anywhere", "series_id", "subset_id", out="spread")
    return c.select("""select subset_id, pick::int as pick, pixel, value, 'disc' as origin from few where subset_id in (from good)
        union all select p.subset_id, p.pick::int, s.pixel, s.value, 'whole map' from spread p join sky s on s.idx = p.place""")


@register(_disc_sql())
def disc_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sa.disc_subset(sky(spark, sf_dir), DISC_SUBSETS, DISC_ANGLE, DISC_SIZE, DISC_STD)
    return out.drop("series_id")


@register(
    f"""with pts as (select label::varchar as label, vec_id as point, embedding[1]::double as p0, embedding[2]::double as p1,
        embedding[3]::double as v0, embedding[4]::double as v1 from embeddings),
    few as (select *, row_number() over (partition by label order by {o.uniform(o.key('pair', 'label', 'point'))}, point) - 1 as pick from pts),
    s as (select * from few where pick < 50)
    select a.label, a.pick::int as i, b.pick::int as j,
        {o.r6('ln(sqrt(pow(a.p0 - b.p0, 2) + pow(a.p1 - b.p1, 2) + pow(a.v0 - b.v0, 2) + pow(a.v1 - b.v1, 2)) + 1)')} as value
    from s a join s b on a.label = b.label and a.pick < b.pick"""
)
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda c: c.cast("double"))
    points = v.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("label"),
        F.col("vec_id").alias("point"),
        e[0].alias("p0"),
        e[1].alias("p1"),
        e[2].alias("v0"),
        e[3].alias("v1"),
    )
    return rounded(sa.pair_features(points, ["label"]), "value")
