"""Fluctuation analysis of whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.operators import fluctuation as fl
from scalefold.plans import oracle as o
from scalefold.plans import views as v
from scalefold.plans.registry import SCALES, SERIES, register, rounded


def _type_chain() -> o.Chain:
    return o.Chain().view("ev_type")



@register(
    o.segment_ctes(_type_chain(), "ev_type", "series_id", SCALES).select(
        f"select series_id, scale_pos, s, seg::bigint as seg, {o.r6('rms')} as rms from seg"
    )
)
def mfdfa_segment_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fl.segment_rms(v.ev_type(spark, sf_dir), SERIES, SCALES), "rms")


@register(
    o.fluct_ctes(o.segment_ctes(_type_chain(), "ev_type", "series_id", SCALES), "series_id").select(
        f"select series_id, scale_pos, s, q_pos, n_segments, {o.r6('f')} as f from fl"
    )
)
def mfdfa_fluctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fl.fluctuation(v.ev_type(spark, sf_dir), SERIES, SCALES), "f")


@register(
    o.measure_ctes(_type_chain(), "ev_type", "series_id", SCALES).select(
        f"select series_id, q_pos, n_scales, {o.r6('h')} as h, {o.r6('tau')} as tau from spec"
    )
)
def mfdfa_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fl.measure(v.ev_type(spark, sf_dir), SERIES, SCALES)
    return rounded(spec.select("series_id", "q_pos", "n_scales", "h", "tau"), "h", "tau")


@register(
    o.measure_ctes(_type_chain(), "ev_type", "series_id", SCALES).select(
        f"""select series_id, {o.r6('avg(alpha)')} as d_f, {o.r6('avg(h)')} as mean_h, count(h) as n_valid_q,
        max(n_scales) as n_scales_used from spec group by series_id"""
    )
)
def mfdfa_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fl.measure(v.ev_type(spark, sf_dir), SERIES, SCALES)
    return rounded(fl.dimension(spec, SERIES), "d_f", "mean_h")


@register(
    o.measure_ctes(_type_chain(), "ev_type", "series_id", SCALES).select(
        f"select series_id, q_pos, {o.r6('alpha')} as alpha, {o.r6('f_alpha')} as f_alpha from spec where alpha is not null"
    )
)
def mfdfa_falpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fl.measure(v.ev_type(spark, sf_dir), SERIES, SCALES)
    out = spec.filter(F.col("alpha").isNotNull()).select("series_id", "q_pos", "alpha", "f_alpha")
    return rounded(out, "alpha", "f_alpha")


_DETREND = (
    o.Chain()
    .view("li_flag")
    .add("cut", f"""select series_id, b.scale_pos, b.s, idx // b.s as seg, (idx % b.s)::double as x, value from li_flag,
        (select unnest({o.list_sql(range(len(SCALES)))}) as scale_pos, unnest({o.list_sql(SCALES)}) as s) b""")
    .add("fit", """select series_id, scale_pos, s, seg, count(value) as n, avg(value) as m, stddev_pop(value) as sd,
        s::double * s * covar_pop(value, x) / (s::double * s * (s::double * s - 1) / 12 + 1e-5) as slope,
        avg(value) * 1e-5 / (s::double * s * (s::double * s - 1) / 12 + 1e-5) as rest
        from cut group by series_id, scale_pos, s, seg""")
    .add("res", """select a.series_id, a.scale_pos, a.s, a.seg, b.n, b.sd,
        pow((a.value - b.m) - b.slope * (a.x - (a.s - 1) / 2.0::double) + b.rest, 2) as r2
        from cut a join fit b on a.series_id = b.series_id and a.scale_pos = b.scale_pos and a.seg = b.seg""")
    .select(f"""select series_id, scale_pos, s, seg::bigint as seg, {o.r6('sqrt(avg(r2) + 1e-12)')} as rms from res
        where n = s and sd >= 1e-10 group by series_id, scale_pos, s, seg""")
)


@register(_DETREND)
def mfdfa_linear_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fl.segment_rms(v.li_flag(spark, sf_dir), SERIES, SCALES, detrend=1), "rms")


_VALID = (
    o.measure_ctes(o.Chain().view("li_supp"), "li_supp", "series_id", SCALES)
    .add("steps", """select series_id, q_pos, (h - lag(h) over w) / (q - lag(q) over w) as rise from hq where h is not null
        window w as (partition by series_id order by q_pos)""")
    .add("ratio", "select series_id, count(h) / count(*)::double as valid_ratio from hq group by series_id")
    .add("top", "select series_id, max(rise) as max_rise from steps group by series_id")
    .select(f"""select a.series_id, {o.r6('valid_ratio')} as valid_ratio, {o.r6('max_rise')} as max_rise,
        valid_ratio >= 0.6 and coalesce(max_rise <= 0.05, false) as is_valid
        from ratio a left join top b on a.series_id = b.series_id""")
)


@register(_VALID)
def hq_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fl.measure(v.li_supp(spark, sf_dir), SERIES, SCALES)
    return rounded(fl.reliable(spec, SERIES), "valid_ratio", "max_rise")


def _spectrum_sql(c: o.Chain) -> str:
    o.spectrum_ctes(o.fluct_ctes(c, "series_id"), "series_id")
    return c.select(f"select series_id, q_pos, n_scales, {o.r6('h')} as h, {o.r6('alpha')} as alpha from spec")


_PROFILE = _type_chain().add(
    "prof", """select series_id, idx, sum(value - m) over (partition by series_id order by idx rows unbounded preceding) as value
        from (select *, avg(value) over (partition by series_id) as m from ev_type)"""
)


@register(_spectrum_sql(o.segment_ctes(_PROFILE, "prof", "series_id", SCALES)))
def mfdfa_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum of the running sums of the centred series."""
    spec = fl.measure(v.ev_type(spark, sf_dir), SERIES, SCALES, profile=True)
    return rounded(spec.select("series_id", "q_pos", "n_scales", "h", "alpha"), "h", "alpha")


_TWO_SIDED = (
    _type_chain()
    .add("sized", "select *, count(*) over (partition by series_id) as n from ev_type")
    .add("cut", f"""select series_id, b.scale_pos, b.s, unnest([idx // b.s, -1 - (n - 1 - idx) // b.s]) as seg, value from sized,
        (select unnest({o.list_sql(range(len(SCALES)))}) as scale_pos, unnest({o.list_sql(SCALES)}) as s) b""")
    .add("seg", """select series_id, scale_pos, s, seg, sqrt(var_pop(value) + 1e-12) as rms from cut
        group by series_id, scale_pos, s, seg having count(value) = s and sqrt(var_pop(value)) >= 1e-10""")
)


@register(_spectrum_sql(_TWO_SIDED))
def mfdfa_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum with segments counted from both ends of the series."""
    spec = fl.measure(v.ev_type(spark, sf_dir), SERIES, SCALES, bidirectional=True)
    return rounded(spec.select("series_id", "q_pos", "n_scales", "h", "alpha"), "h", "alpha")
