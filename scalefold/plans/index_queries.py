"""Summaries of subset results, coherence indices and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.config import family_config
from scalefold.operators import channels as ch
from scalefold.operators import coherence as co
from scalefold.operators import export as ex
from scalefold.operators import fluctuation as fl
from scalefold.operators import packed as pk
from scalefold.operators import sampling as sa
from scalefold.operators import summary as su
from scalefold.operators.denoise import measurement_channels
from scalefold.operators.indexing import lengths
from scalefold.plans import oracle as o
from scalefold.plans import run
from scalefold.plans import views as v
from scalefold.plans.registry import SCALES, SERIES, register, rounded
from scalefold.plans.sampling_queries import LEDGER, ledger, ledger_measures
from scalefold.session import land

EXPECTED = LEDGER.expected_df


def _supp() -> o.Chain:
    return o.subset_measure_ctes(o.Chain().view("li_supp"), "li_supp", LEDGER.subset_size, LEDGER.n_subsets, SCALES)


def _results(spark: SparkSession, df: DataFrame) -> DataFrame:
    # ordering the rows is the dear part of a view: done once, not for lengths and samples apart
    _, windows, measures = ledger_measures(spark, land(df, "series"), pk.SUMMARY)
    return run.subset_results(measures, windows)


# --- summaries --------------------------------------------------------------


@register(
    o.summary_ctes(_supp(), EXPECTED).select(
        f"select series_id, subset_id, {o.r6('median_df')} as median_df, {o.r6('mad')} as mad, in_core from core"
    )
)
def mad_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = su.mad_core(_results(spark, v.li_supp(spark, sf_dir)))
    return rounded(marked.select("series_id", "subset_id", "median_df", "mad", "in_core"), "median_df", "mad")


@register(
    o.summary_ctes(_supp(), EXPECTED).select(
        f"""select series_id, n_subsets, n_valid, {o.r6('mean_df')} as mean_df, {o.r6('std_df')} as std_df,
        {o.r6('mean_h')} as mean_h, {o.r6('nan_ratio')} as nan_ratio from summ"""
    )
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = su.dataset_summary(_results(spark, v.li_supp(spark, sf_dir)), family_config(spark, [LEDGER]))
    names = ["mean_df", "std_df", "mean_h", "nan_ratio"]
    return rounded(out.select("series_id", "n_subsets", "n_valid", *names), *names)


@register(
    o.summary_ctes(_supp(), EXPECTED).select(f"select series_id, {o.r6('z')} as z, {o.r6('p_value')} as p_value from summ")
)
def ztest_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = su.dataset_summary(_results(spark, v.li_supp(spark, sf_dir)), family_config(spark, [LEDGER]))
    return rounded(out.select("series_id", "z", "p_value"), "z", "p_value")


@register(
    _supp()
    .add("prof", """select series_id, q_pos, avg(h) as h_mean, stddev_pop(h) as h_std, min(h) as h_min, max(h) as h_max
        from spec group by series_id, q_pos""")
    .add("width", "select series_id, max(h_mean) - min(h_mean) as h_width from prof group by series_id")
    .select(f"""select p.series_id, q_pos, {o.r6('h_mean')} as h_mean, {o.r6('h_std')} as h_std, {o.r6('h_min')} as h_min,
        {o.r6('h_max')} as h_max, {o.r6('h_width')} as h_width from prof p join width w on p.series_id = w.series_id""")
)
def spectrum_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = su.spectrum_profile(pk.spectrum_rows(ledger_measures(spark, land(v.li_supp(spark, sf_dir), "series"), ["h"])[2]))
    out = profile.join(su.spectrum_width(profile), "series_id")
    return rounded(out, "h_mean", "h_std", "h_min", "h_max", "h_width")


@register(
    o.summary_ctes(_supp(), EXPECTED)
    .add("prof", "select series_id, q_pos, avg(h) as h_mean from spec group by series_id, q_pos")
    .add("width", "select series_id, max(h_mean) - min(h_mean) as h_width from prof group by series_id")
    .select(f"""select p.series_id, case when n_valid = 0 then 'FAIL' when nan_ratio > 0.5 or n_valid < greatest(3, floor(0.2::double * p.n_subsets))
        then 'WARN' else 'OK' end as status, case when n_valid = 0 then 'No valid D_f' end as reason, n, p.n_subsets::int as n_subsets, n_valid,
        {o.r6('nan_ratio')} as nan_ratio, {o.r6('df_mean_all')} as df_mean, {o.r6('df_std_all')} as df_std, {o.r6('h_width')} as h_width,
        {o.r6('p_value')} as p_value, case when n < 1250 then 'adaptive' else 'fixed' end as mode,
        case when n < 1250 then 'n_total < 1250' end as trigger, size::int as size, {o.r6('size / n::double')} as fraction,
        case when n_valid = 0 then 1 else 0 end::bigint as n_errors
        from plan p left join summ s on p.series_id = s.series_id left join width w on p.series_id = w.series_id""")
)
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = v.li_supp(spark, sf_dir)
    samples = land(samples, "series")
    plan, windows, measures = ledger_measures(spark, samples, [*pk.SUMMARY, "h"])
    # both the results and the profile read the measures: written once
    measures = land(measures, "measures")
    spectra = pk.spectrum_rows(measures)
    results = run.subset_results(measures, windows)
    summary = su.dataset_summary(results, family_config(spark, [LEDGER]))
    errors = ex.errors(results, lengths(samples, SERIES))
    out = su.health(summary, su.spectrum_width(su.spectrum_profile(spectra)), plan, errors)
    return rounded(out, "nan_ratio", "df_mean", "df_std", "h_width", "p_value", "fraction")


@register(
    o.subset_measure_ctes(
        o.Chain().view("li_supp").view("ord_cust").add("joined", "select * from li_supp union all select 'c' || series_id, idx, value from ord_cust"),
        "joined", LEDGER.subset_size, LEDGER.n_subsets, SCALES,
    ).select(
        """select series_id, subset_id, case when start is null then 'Data too short' else 'No valid D_f' end as reason
        from res where d_f is null"""
    )
)
def subset_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = v.ord_cust(spark, sf_dir).withColumn("series_id", F.concat(F.lit("c"), "series_id"))
    return ex.subset_warnings(_results(spark, v.li_supp(spark, sf_dir).unionByName(customers)))


# --- coherence --------------------------------------------------------------


@register(
    o.interpolate_ctes(o.measure_ctes(o.Chain().view("li_supp"), "li_supp", "series_id", SCALES)).select(
        f"select series_id, q_pos, {o.r6('h')} as h from full_h"
    )
)
def spectrum_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fl.measure(v.li_supp(spark, sf_dir), SERIES, SCALES)
    return rounded(co.interpolate(spec).select("series_id", "q_pos", "h"), "h")


@register(
    o.pair_ctes(
        o.measure_ctes(o.Chain().view("ev_type"), "ev_type", "series_id", SCALES).add(
            "sp", "select -1 as fold, series_id, q_pos, h from hq"
        ),
        "sp",
        "pairs",
    ).select(f"select ds_a, ds_b, n_q, {o.r6('abs_corr')} as abs_corr from pairs")
)
def pair_abs_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fl.measure(v.ev_type(spark, sf_dir), SERIES, SCALES)
    pairs = co.pair_correlations(co.pack(spec), "TCI")
    return rounded(pairs.select("ds_a", "ds_b", "n_q", "abs_corr"), "abs_corr")


def _flag_whole() -> o.Chain:
    return o.interpolate_ctes(o.whole_spectrum_ctes(o.Chain().view("li_flag"), "li_flag"), "t", "tfull")


@register(
    o.pair_ctes(_flag_whole().add("sp", "select -1 as fold, series_id, q_pos, h from tfull"), "sp", "pairs").select(
        f"select {o.r6('avg(abs_corr)')} as tci, count(abs_corr) as n_pairs from pairs"
    )
)
def tci(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = co.interpolate(co.whole_spectra(land(v.li_flag(spark, sf_dir), "series")))
    out = co.mean_coherence(co.pack(spec), "tci").select("tci", F.col("tci_pairs").alias("n_pairs"))
    return rounded(out, "tci")


def _flag_subsets() -> o.Chain:
    return o.subset_measure_ctes(o.Chain().view("li_flag"), "li_flag", LEDGER.subset_size, LEDGER.n_subsets, SCALES)


@register(
    o.pair_ctes(
        _flag_subsets().add("sp", "select -1 as fold, series_id, q_pos, avg(h) as h from spec group by series_id, q_pos"),
        "sp",
        "pairs",
    ).select(f"select {o.r6('avg(abs_corr)')} as mci, count(abs_corr) as n_pairs from pairs")
)
def mci(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = pk.spectrum_rows(ledger_measures(spark, land(v.li_flag(spark, sf_dir), "series"), ["h"])[2])
    out = co.mean_coherence(co.pack(co.mean_spectra(spectra)), "mci").select("mci", F.col("mci_pairs").alias("n_pairs"))
    return rounded(out, "mci")


def _indices(spark: SparkSession, samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Packed spectra of both indices, subset results, and indices with their bootstrap."""
    samples = land(samples, "series")
    _, windows, measures = ledger_measures(spark, samples, [*pk.SUMMARY, "h"])
    measures = land(measures, "measures")
    spectra = pk.spectrum_rows(measures)
    whole = land(co.whole_spectra(samples), "whole")  # read once for the full run and once for the folds
    tci_packed, mci_packed = run.index_spectra(whole, spectra, windows)
    indices = co.assemble(land(run.compute_indices(tci_packed, mci_packed), "indices"))
    return tci_packed, mci_packed, run.subset_results(measures, windows), indices


def _index_chain(view: str) -> o.Chain:
    c = o.whole_spectrum_ctes(o.Chain().view(view), view)
    return o.index_ctes(o.subset_measure_ctes(c, view, LEDGER.subset_size, LEDGER.n_subsets, SCALES))


_INDEX_COLUMNS = ["tci", "mci", "tmci", "ci_lo", "ci_hi", "corr"]


@register(
    _index_chain("ev_type").select(
        f"select fold, {', '.join(o.r6(n) + ' as ' + n for n in _INDEX_COLUMNS)} from indices where fold = -1"
    )
)
def tmci_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = _indices(spark, v.ev_type(spark, sf_dir))[3]
    return rounded(indices.filter("fold = -1").select("fold", *_INDEX_COLUMNS), *_INDEX_COLUMNS)


@register(
    _index_chain("li_flag").select(
        f"""select fold, {', '.join(o.r6(n) + ' as ' + n for n in _INDEX_COLUMNS)},
        {o.r6('(select stddev_pop(tmci) from indices where fold >= 0)')} as tmci_std_cv from indices"""
    )
)
def tmci_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = _indices(spark, v.li_flag(spark, sf_dir))[3]
    out = indices.crossJoin(co.fold_spread(indices).select("tmci_std_cv"))  # one row
    return rounded(out.select("fold", *_INDEX_COLUMNS, "tmci_std_cv"), *_INDEX_COLUMNS, "tmci_std_cv")


def _empty(*given: str) -> str:
    """The flat table's columns, those not given as typed NULLs."""
    types = {"string": "varchar", "int": "int", "double": "double"}
    have = dict(g.split(" as ", 1)[::-1] for g in given)
    return ", ".join(f"{have.get(c, '-1' if t == 'int' else 'null')}::{types[t]} as {c}" for c, t in ex.FLAT_COLUMNS.items())


@register(
    _index_chain("li_flag").select(
        f"""select {_empty("'TCI' as type", "ds_a || '|' || ds_b as pair", o.r6('abs_corr') + ' as corr')} from tcip where fold = -1
        union all select {_empty("'MCI' as type", "ds_a || '|' || ds_b as pair", o.r6('abs_corr') + ' as corr')} from mcip where fold = -1
        union all select {_empty("'TMCI_fold' as type", 'fold as fold_idx', o.r6('tmci') + ' as tmci_value')} from indices where fold >= 0
        union all select {_empty("'MFDFA_subset' as type", 'series_id as dataset', 'subset_id as subset_idx',
            o.r6('d_f') + ' as D_f', o.r6('mean_h') + ' as hq_mean')} from res
        union all select {_empty("'GLOBAL' as type", o.r6('tci') + ' as tci_global', o.r6('mci') + ' as mci_global',
            o.r6('tmci') + ' as tmci_global', o.r6('(select stddev_pop(tmci) from indices where fold >= 0)') + ' as tmci_std_cv')}
            from indices where fold = -1"""
    )
)
def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tci_packed, mci_packed, results, indices = _indices(spark, v.li_flag(spark, sf_dir))
    indices = land(indices, "indices")
    pairs = run.compute_pairs(tci_packed, mci_packed)
    out = ex.flat_results(pairs, results, indices, co.fold_spread(indices))
    # whole-number columns without NULLs read the same everywhere
    out = out.fillna(-1, ["subset_idx", "fold_idx"])
    return rounded(out, *[c for c, t in ex.FLAT_COLUMNS.items() if t == "double"])


@register(
    o.pair_ctes(_flag_whole().add("sp", "select -1 as fold, series_id, q_pos, h from tfull"), "sp", "pairs")
    .add("sides", "select ds_a as series_id, abs_corr from pairs union all select ds_b, abs_corr from pairs")
    .add("np", "select series_id, count(abs_corr) as n_pairs from sides group by series_id")
    .select("""select h.series_id, count(*) as hq_length, count(h) as n_valid, max(n_pairs) as n_pairs
        from hqt h join np on h.series_id = np.series_id group by h.series_id""")
)
def index_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = land(co.whole_spectra(land(v.li_flag(spark, sf_dir), "series")), "whole")
    return ex.index_diagnostics(whole, co.defined_pairs(co.pack(co.interpolate(whole))))


# --- exports ----------------------------------------------------------------


@register(
    o.Chain().view("li_flag").select(
        f"""select series_id, length_full, least(length_full, 6000) as length_used, length_full > 6000 as truncated,
        {o.r6('mean')} as mean, {o.r6('last')} as last from (select series_id, count(*) as length_full,
        avg(value) filter (idx < 6000) as mean, arg_max(value, idx) filter (idx < 6000) as last from li_flag group by series_id)"""
    )
)
def series_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = ex.snapshot(v.li_flag(spark, sf_dir), 6000)
    out = snap.select(
        "series_id",
        "length_full",
        "length_used",
        "truncated",
        (F.aggregate("data", F.lit(0.0), lambda a, x: a + x) / F.col("length_used")).alias("mean"),
        F.element_at("data", -1).alias("last"),
    )
    return rounded(out, "mean", "last")


@register(
    o.Chain()
    .view("li_supp_channels")
    .add("catalog", "select distinct s_suppkey::varchar as series_id from supplier union select 'missing' as series_id")
    .add("sizes", """select series_id, count(*) filter (channel = 0) as n_rows, count(distinct channel) as n_channels, count(value) as n_values,
        max(idx) + 1 as longest from li_supp_channels group by series_id""")
    .select("""select c.series_id, coalesce(n_rows, 0) as n_rows, coalesce(n_channels, 0) as n_channels, coalesce(n_values, 0) as n_values,
        coalesce(longest, 0) as tci_length, coalesce(longest, 0) as matrix_rows,
        case when longest is null then 0 else 2 end::bigint as matrix_columns,
        case when n_rows < 1250 and n_rows >= 10 then 75 when n_rows >= 1250 then 100 else 0 end::int as n_subsets,
        case when n_rows >= 10 then 'OK' else 'SKIPPED' end as status from catalog c left join sizes s on c.series_id = s.series_id""")
)
def load_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = v.li_supp_channels(spark, sf_dir)
    suppliers = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("series_id"))
    catalog = suppliers.unionByName(spark.range(1).select(F.lit("missing").alias("series_id"))).distinct()
    plan = ledger(spark, samples.filter("channel = 0"))[1]
    tagged = samples.withColumn("family", F.lit(LEDGER.name))
    index_samples = run.index_series(tagged, [LEDGER])
    matrix = measurement_channels(tagged, run.recipes([LEDGER]), least=1)
    return ex.load_meta(samples, catalog, plan.select("series_id", "n_subsets"), index_samples, matrix).fillna(0)


_MANIFEST = """'{"series_id":"' || series_id || '","family":"ledger","n":' || n || ',"size":' || size || ',"n_subsets":' || n_subsets
    || ',"mode":"' || mode || '"}'"""


@register(
    o.subset_ctes(o.Chain().view("li_supp"), "li_supp", LEDGER.subset_size, LEDGER.n_subsets).select(
        f"select series_id, {_MANIFEST} as definition, sha256({_MANIFEST}) as sha256 from plan"
    )
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = ledger(spark, v.li_supp(spark, sf_dir))[1]
    return ex.manifest(plan).select("series_id", "definition", "sha256")
