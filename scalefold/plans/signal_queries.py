"""Smoothing, wavelets, filters, power spectra and denoising."""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.functions.numeric import soft_threshold as soft
from scalefold.operators import smoothing as sm
from scalefold.operators import wavelet as wv
from scalefold.operators.cleaning import STRAIN_GAIN
from scalefold.operators.denoise import denoise, measurement_channels
from scalefold.operators.indexing import lengths
from scalefold.operators.power import normalised_bins, welch
from scalefold.operators.recursive import bandpass as band_filter
from scalefold.operators.recursive import state_space
from scalefold.plans import oracle as o
from scalefold.plans import views as v
from scalefold.plans.registry import SERIES, register, rounded
from scalefold.session import land


# --- DuckDB fragments -------------------------------------------------------


def mean_sql(src: str, width: int, value: str = "value") -> str:
    m = width // 2
    return f"""select series_id, idx, (sum({value}) over (w rows between {m} preceding and {m} following)
        + greatest({m} - idx, 0) * first_value({value}) over (w rows between unbounded preceding and unbounded following)
        + greatest({m} - (count(*) over (partition by series_id) - 1 - idx), 0)
          * last_value({value}) over (w rows between unbounded preceding and unbounded following)) / {width} as value
        from {src} window w as (partition by series_id order by idx)"""


def quad_sql(src: str) -> str:
    terms = []
    for k, weight in zip(range(-5, 6), sm.QUAD_WEIGHTS):
        end = "first" if k < 0 else "last"
        at = "value" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(value, {abs(k)}) over w, {end}_value(value) over full_w)"
        terms.append(f"({weight}) * {at}")
    return f"""select series_id, idx, ({' + '.join(terms)}) / {float(sm.QUAD_SUM)}::double as value from {src}
        window w as (partition by series_id order by idx),
        full_w as (partition by series_id order by idx rows between unbounded preceding and unbounded following)"""


def _taps(values) -> str:
    return "[" + ", ".join(f"{x!r}::double" for x in values) + "]"


def analysis_ctes(c: o.Chain, src: str, out: str) -> o.Chain:
    """One level: mirrored samples against the taps. ``src(series_id, idx, value)``."""
    c.add(f"{out}_n", f"select series_id, count(*) as n from {src} group by series_id")
    c.add(f"{out}_e", f"""select series_id, n, k, j, (((2 * k + 1 - j) % (2 * n)) + 2 * n) % (2 * n) as p from
        (select series_id, n, unnest(range((n + 7) // 2)) as k from {out}_n), (select unnest(range(8)) as j)""")
    return c.add(out, f"""select e.series_id, e.k as idx, sum(v.value * {_taps(wv.LOW)}[j + 1]) as approx,
        sum(v.value * {_taps(wv.HIGH)}[j + 1]) as detail from {out}_e e join {src} v
        on e.series_id = v.series_id and v.idx = case when p < n then p else 2 * n - 1 - p end group by e.series_id, e.k""")


def shrink_ctes(c: o.Chain, src: str, level: int, tag: str) -> o.Chain:
    """All levels forwards, the threshold, all levels back; the result is ``{tag}``."""
    at = src
    for lv in range(1, level + 1):
        analysis_ctes(c, at, f"{tag}a{lv}")
        c.add(f"{tag}s{lv}", f"select series_id, idx, approx as value from {tag}a{lv}")
        at = f"{tag}s{lv}"
    c.add(f"{tag}t", f"""select a.series_id, sd * sqrt(2 * ln(n)) as t from
        (select series_id, stddev_pop(detail) as sd from {tag}a1 group by series_id) a
        join (select series_id, count(*) as n from {src} group by series_id) b on a.series_id = b.series_id""")
    shrunk = "sign({x}) * greatest(abs({x}) - t, 0)"
    c.add(f"{tag}r{level}", f"""select a.series_id, idx, {shrunk.format(x='approx')} as value
        from {tag}a{level} a join {tag}t t on a.series_id = t.series_id""")
    for lv in range(level, 0, -1):
        c.add(f"{tag}m{lv}", f"""select d.series_id, d.idx, r.value as approx, {shrunk.format(x='d.detail')} as detail
            from {tag}a{lv} d join {tag}t t on d.series_id = t.series_id
            join {tag}r{lv} r on d.series_id = r.series_id and d.idx = r.idx""")
        # output x[m] takes coefficient k with filter position 7 - (m + 6 - 2k)
        c.add(f"{tag}r{lv - 1}", f"""select series_id, idx, sum(x) as value from (
            select series_id, 2 * idx - 6 + u as idx, approx * {_taps(wv.LOW[::-1])}[u + 1] + detail * {_taps(wv.HIGH[::-1])}[u + 1] as x,
            max(2 * idx + 2) over (partition by series_id) - 6 as size
            from {tag}m{lv}, (select unnest(range(8)) as u)) where idx >= 0 and idx < size group by series_id, idx""")
    return c.add(tag, f"select r.series_id, r.idx, r.value from {tag}r0 r join {src} v on r.series_id = v.series_id and r.idx = v.idx")


# --- queries ----------------------------------------------------------------


# Some values of every series are undefined; so is each window that holds one.
GAP = "idx % 50 = 20"


def _gaps(reach: int) -> o.Chain:
    """``ev_type`` with undefined values as ``src``, and where a window of ``reach`` neighbours is whole as ``ok``."""
    c = o.Chain().view("ev_type")
    c.add("src", f"select series_id, idx, case when {GAP} then null else value end as value from ev_type")
    return c.add("ok", f"""select series_id, idx, count(value) over w = count(*) over w as whole from src
        window w as (partition by series_id order by idx rows between {reach} preceding and {reach} following)""")


_SMOOTHED = f"""select s.series_id, s.idx, case when whole then {o.r6('value')} end as value
    from s join ok on s.series_id = ok.series_id and s.idx = ok.idx"""


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.ev_type(spark, sf_dir).withColumn("value", F.expr(f"if({GAP}, null, value)"))


@register(_gaps(3).add("s", mean_sql("src", 7)).select(_SMOOTHED))
def smooth_ma7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sm.smooth_mean(_with_gaps(spark, sf_dir), SERIES, 7), "value")


@register(_gaps(5).add("s", quad_sql("src")).select(_SMOOTHED))
def smooth_quad11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sm.smooth_quadratic(_with_gaps(spark, sf_dir), SERIES), "value")


@register(
    analysis_ctes(o.Chain().view("li_supp"), "li_supp", "a").select(
        f"select series_id, idx as k, {o.r6('approx')} as approx, {o.r6('detail')} as detail from a"
    )
)
def wavelet_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wv.analyse(v.li_supp(spark, sf_dir), SERIES), "approx", "detail")


@register(
    analysis_ctes(o.Chain().view("li_supp"), "li_supp", "a")
    .add("t", """select a.series_id, stddev_pop(detail) * max(sqrt(2 * ln(n))) as t from a
        join a_n b on a.series_id = b.series_id group by a.series_id""")
    .select(f"""select a.series_id, idx as k, {o.r6('sign(detail) * greatest(abs(detail) - t, 0)')} as detail
        from a join t on a.series_id = t.series_id""")
)
def soft_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.li_supp(spark, sf_dir)
    details = wv.analyse(df, SERIES).select("series_id", "k", "detail")
    limit = details.groupBy("series_id").agg(F.stddev_pop("detail").alias("sd")).join(lengths(df, SERIES), "series_id")
    limit = limit.select("series_id", (F.col("sd") * F.sqrt(2.0 * F.ln(F.col("n").cast("double")))).alias("t"))
    out = details.join(limit, "series_id").select("series_id", "k", soft(F.col("detail"), F.col("t")).alias("detail"))
    return rounded(out, "detail")


@register(
    shrink_ctes(o.Chain().view("li_supp"), "li_supp", 4, "w").select(
        f"select series_id, idx, case when series_id <> '1' then {o.r6('value')} end as value from w"
    )
)
def wavelet_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series has an undefined value and comes out undefined."""
    samples = v.li_supp(spark, sf_dir).withColumn("value", F.expr("if(series_id = '1' and idx = 7, null, value)"))
    return rounded(wv.shrink(samples, SERIES, 4), "value")


def _impulse_terms(sections) -> tuple[float, list[tuple[float, float, float, float]]]:
    """Direct gain and, per conjugate pole pair, (radius, angle, residue real, residue imaginary)."""
    a, b, c, d = state_space(sections)
    poles, vectors = np.linalg.eig(a)
    residues = (c @ vectors) * np.linalg.solve(vectors.astype(complex), b.astype(complex))
    pairs = [(p, r) for p, r in zip(poles, residues) if p.imag > 0]
    return float(d), [(float(abs(p)), cmath.phase(p), float(2 * r.real), float(2 * r.imag)) for p, r in pairs]


# An order-2 band-pass from 400 to 1,600 Hz at 16,384 samples a second. Its response dies
# out within a few hundred samples, so SQL can write it as a plain convolution.
MID_SECTIONS = [
    [0.039585404292026956, 0.07917080858405391, 0.039585404292026956, 1.0, -1.3805147301973972, 0.6132085476906438],
    [1.0, -2.0, 1.0, 1.0, -1.8232743178077877, 0.8512954080720049],
]


def _band_sql(src: str) -> str:
    d, terms = _impulse_terms(MID_SECTIONS)
    taps = max(int(-46 / math.log(r)) for r, *_ in terms)
    response = " + ".join(
        f"pow({r!r}::double, k - 1) * ({cr!r}::double * cos({a!r}::double * (k - 1)) - ({ci!r}::double) * sin({a!r}::double * (k - 1)))"
        for r, a, cr, ci in terms
    )
    return f"""select series_id, idx, sum(x) as value from (
        select s.series_id, s.idx + k as idx, s.value * h as x, n from {src} s
        join (select series_id, count(*) as n from {src} group by series_id) l on s.series_id = l.series_id,
        (select 0 as k, {d!r}::double as h union all select k, {response} as h from (select unnest(range(1, {taps + 1})) as k)))
        where idx < n group by series_id, idx"""


@register(
    o.Chain().view("li_flag").add("b", _band_sql("li_flag")).select(f"select series_id, idx, {o.r6('value / 10000')} as value from b")
)
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = band_filter(v.li_flag(spark, sf_dir), SERIES, MID_SECTIONS, chunk=1024)
    return rounded(out.withColumn("value", F.col("value") / 1e4), "value")


def welch_ctes(c: o.Chain, src: str, tag: str = "") -> o.Chain:
    """D7 on ``src(series_id, idx, value)``: lengths as ``n{tag}``, spectra as ``psd{tag}``, their peaks as ``peak{tag}``."""
    c.add(f"n{tag}", f"select series_id, count(*) as n, least(1024, count(*) // 4) as nps from {src} group by series_id")
    c.add(f"fr{tag}", f"select series_id, n, nps, unnest(range((n - nps) // (nps - nps // 2) + 1)) as f from n{tag} where nps > 0")
    c.add(f"x{tag}", f"""select a.series_id, nps, f, v.idx - f * (nps - nps // 2) as i, v.value from fr{tag} a join {src} v
        on a.series_id = v.series_id and v.idx >= f * (nps - nps // 2) and v.idx < f * (nps - nps // 2) + nps""")
    c.add(f"xw{tag}", f"""select series_id, nps, f, i, (value - avg(value) over (partition by series_id, f))
        * (0.5 - 0.5 * cos(2 * pi() * i / nps)) as y, pow(0.5 - 0.5 * cos(2 * pi() * i / nps), 2) as w2 from x{tag}""")
    c.add(f"dft{tag}", f"""select series_id, nps, f, k, sum(y * cos(2 * pi() * ((i * k) % nps) / nps)) as re,
        sum(y * sin(2 * pi() * ((i * k) % nps) / nps)) as im, sum(w2) as w2
        from (select *, unnest(range(nps // 2 + 1)) as k from xw{tag}) group by series_id, nps, f, k""")
    c.add(f"psd{tag}", f"""select series_id, nps, k as bin, count(*) as n_frames,
        avg((re * re + im * im) / w2 * case when k = 0 or 2 * k = nps then 1 else 2 end) as power
        from dft{tag} group by series_id, nps, k""")
    return c.add(f"peak{tag}", f"select series_id, max(power) as m, count(*) as b from psd{tag} group by series_id")


def _welch() -> o.Chain:
    return welch_ctes(o.Chain().view("li_supp"), "li_supp")


@register(_welch().select(f"select series_id, nps::int as nps, bin::int as bin, n_frames, {o.r6('power / 1000000')} as power from psd"))
def welch_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(welch(v.li_supp(spark, sf_dir), SERIES).withColumn("power", F.col("power") / 1e6), "power")


@register(
    _welch().select(
        f"""select p.series_id, bin::int as bin, {o.r6('power / (m + 1e-10)')} as value, n.n // b + 1 as repeat
        from psd p join peak on p.series_id = peak.series_id join n on p.series_id = n.series_id where bin < 8"""
    )
)
def psd_first_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.li_supp(spark, sf_dir)
    return rounded(normalised_bins(welch(df, SERIES), df, SERIES), "value")


# Views standing for families, so that every recipe has series of its own.
RECIPE_VIEWS = {"strain": "ev_type", "lines": "li_supp", "pulsar": "ev_user", "z_score": "emb", "unit_std": "li_flag"}


def _denoise_sql() -> str:
    c = o.Chain()
    for view in RECIPE_VIEWS.values():
        c.view(view)
    c.add("strain", mean_sql("ev_type", 7))
    c.add("logs", "select series_id, idx, ln(abs(value) + 1) as value from li_supp")
    shrink_ctes(c, "logs", 4, "lw").add("lines", mean_sql("lw", 5))
    shrink_ctes(c, "ev_user", 5, "pw").add("pulsar", quad_sql("pw"))
    c.add("z_score", """select series_id, idx, (value - avg(value) over w) / (stddev_pop(value) over w + 1e-10) as value
        from emb window w as (partition by series_id)""")
    c.add("unit_std", "select series_id, idx, value / stddev_pop(value) over (partition by series_id) as value from li_flag")
    return c.select(
        " union all ".join(f"select '{f}' as family, series_id, idx, {o.r6('value')} as value from {f}" for f in RECIPE_VIEWS)
    )


@register(_denoise_sql())
def denoise_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = None
    for family, view in RECIPE_VIEWS.items():
        part = getattr(v, view)(spark, sf_dir).withColumn("family", F.lit(family))
        samples = part if samples is None else samples.unionByName(part)
    clean = denoise(samples, SERIES, {f: f for f in RECIPE_VIEWS})
    # the strain gain is taken back out, so that six decimals mean the same for all
    value = F.when(F.col("family") == "strain", F.col("value") / STRAIN_GAIN).otherwise(F.col("value"))
    return rounded(clean.withColumn("value", value), "value")


def _matrix_sql() -> str:
    c = o.Chain().view("ev_channels").view("li_supp").view("emb")
    c.add("ch", "select channel, count(*) as n, stddev_pop(value) as sd from ev_channels group by channel having count(*) >= 100")
    c.add("best", "select * from ch order by n desc, channel desc limit 1")
    c.add("grid", "select s.channel as col, unnest(range(b.n)) as idx, s.sd from ch s, best b where s.channel <> b.channel")
    # a power family, denoised; and short pulsars without side channels, as they are
    c.add("unit", "select series_id, idx, value / stddev_pop(value) over (partition by series_id) as value from li_supp")
    welch_ctes(welch_ctes(c, "unit", "_u"), "emb", "_e")
    parts = [f"""select 'events' as series_id, g.col, g.idx, {o.r6('coalesce(e.value / g.sd, 0)')} as value, 'channel' as kind
        from grid g left join ev_channels e on e.channel = g.col and e.idx = g.idx"""]
    for tag, name in (("_u", "'s' || p.series_id"), ("_e", "'e' || p.series_id")):
        parts.append(f"""select {name}, bin, n.n // b + 1, {o.r6('power / (m + 1e-10)')}, 'power' from psd{tag} p
            join peak{tag} k on p.series_id = k.series_id join n{tag} n on p.series_id = n.series_id where bin < 8""")
    return c.select("select series_id, col::int as col, idx, value, kind from (" + " union all ".join(parts) + ")")


@register(_matrix_sql())
def measurement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three branches: side channels, power of a denoised series, power of a short pulsar's residuals."""
    samples = v.ev_channels(spark, sf_dir).withColumn("family", F.lit("catalog"))
    for view, mark, family in ((v.li_supp, "s", "sky_map"), (v.emb, "e", "pulsar")):
        part = view(spark, sf_dir).withColumn("series_id", F.concat(F.lit(mark), "series_id"))
        samples = samples.unionByName(part.withColumns({"family": F.lit(family), "channel": F.lit(0)}))
    recipes = {"catalog": "unit_std", "sky_map": "unit_std", "pulsar": "pulsar"}
    # the choice of channels and every branch read the samples: ordered and written once
    return rounded(measurement_channels(land(samples, "series"), recipes, least=100), "value")
