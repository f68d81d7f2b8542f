"""Cleaning, channels and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.functions import numeric as nu
from scalefold.operators import channels as ch
from scalefold.operators import cleaning as cl
from scalefold.operators.grids import WHOLE_HEAD
from scalefold.operators.indexing import lengths
from scalefold.plans import oracle as o
from scalefold.plans import views as v
from scalefold.plans.registry import SERIES, register, rounded
from scalefold.sources import series as src

_K = "cast(regexp_extract(props, '[0-9]+') as int)"


@register(
    r"""with raw as (select event_id, regexp_extract(props, '[0-9]+') as k, event_type from events),
    txt as (select event_id, case event_type when 'click' then '="' || k || '"' when 'error' then k || 'd'
        when 'view' then ' ' || k || '.25 ' when 'signup' then '''-' || k || 'e1''' else 'nan' end as t from raw),
    bare as (select event_id, t, trim(t, '="'' ') as b from txt)
    select event_id, t as raw, case when regexp_full_match(b, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
        then try_cast(b as double) end as value from bare"""
)
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0)
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('="'), k, F.lit('"')))
        .when(F.col("event_type") == "error", F.concat(k, F.lit("d")))
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), k, F.lit(".25 ")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("'-"), k, F.lit("e1'")))
        .otherwise("nan")
    )
    rows = v.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return rows.withColumn("value", nu.parse_number(F.col("raw")))


@register(
    """select l_returnflag, count(*) as n_rows, sum(l_quantity) as quantity, 5::bigint as n_columns
    from lineitem group by l_returnflag"""
)
def drop_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_returnflag",
        "l_quantity",
        F.when(F.col("l_quantity") < 0, F.col("l_tax")).alias("never"),
        "l_tax",
        F.lit(None).cast("string").alias("empty"),
        "l_shipdate",
    )
    kept = cl.drop_null_columns(wide)
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("l_quantity").alias("quantity"),
        F.lit(len(kept.columns)).cast("bigint").alias("n_columns"),
    )


@register(
    o.Chain().view("ev_user").select(
        f"select series_id, count(*) as n, {o.r6('sum(value)')} as total from ev_user group by series_id having count(value) >= 66"
    )
)
def min_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cl.min_count_gate(v.ev_user(spark, sf_dir), SERIES, 66)
    out = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total")


@register(
    o.Chain()
    .view("li_flag")
    .add("q", "select series_id, quantile_cont(value, 0.025) as a, quantile_cont(value, 0.975) as b from li_flag group by series_id")
    .select("select v.series_id, idx, value from li_flag v join q on v.series_id = q.series_id where value between a and b")
)
def quantile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.quantile_trim(v.li_flag(spark, sf_dir), SERIES)


@register(
    o.Chain()
    .view("li_flag")
    .add("q", "select series_id, quantile_cont(value, 0.01) as a, quantile_cont(value, 0.99) as b from li_flag group by series_id")
    .select(
        f"""select v.series_id, idx, {o.r6('least(greatest(value, a), b)')} as value
        from li_flag v join q on v.series_id = q.series_id"""
    )
)
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cl.winsorize(v.li_flag(spark, sf_dir), SERIES), "value")


@register(
    f"""with raw as (select event_type as series_id, event_id as idx,
        case when {_K} >= 90 then null when {_K} < 5 then 'inf'::double when {_K} < 9 then '-inf'::double
        when {_K} < 12 then 'nan'::double else value end as value from events),
    clean as (select series_id, idx, case when isfinite(value) then value end as value from raw),
    mid as (select series_id, median(value) as m from clean group by series_id)
    select c.series_id, idx, {o.r6('coalesce(value, m)')} as value from clean c join mid on c.series_id = mid.series_id"""
)
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    holes = (
        F.when(k >= 90, F.lit(None))
        .when(k < 5, F.lit(float("inf")))
        .when(k < 9, F.lit(float("-inf")))
        .when(k < 12, F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    raw = v.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.col("event_id").alias("idx"), holes.alias("value")
    )
    return rounded(cl.median_impute(raw, SERIES), "value")


@register(
    o.Chain().view("li_supp_channels").select(
        f"""select series_id, channel, idx, {o.r6('case when channel in (1, 2) then radians(value) else value end')} as value
        from li_supp_channels"""
    )
)
def radians_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cl.to_radians(v.li_supp_channels(spark, sf_dir), [1, 2]), "value")


@register(
    o.Chain().view("li_supp_channels").select(
        f"select series_id, idx, {o.r6('avg(value)')} as value from li_supp_channels group by series_id, idx"
    )
)
def row_mean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ch.row_mean(v.li_supp_channels(spark, sf_dir)), "value")


_GAPPY = """select series_id, channel, idx, case when value >= 0.5 * (channel + 1) then value end as value from ev_channels"""
_RANKED = """select series_id, channel, value, row_number() over (partition by series_id, channel order by idx) - 1 as idx
    from gappy where value is not null"""


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.ev_channels(spark, sf_dir)
    return df.withColumn("value", F.when(F.col("value") >= 0.5 * (F.col("channel") + 1), F.col("value")))


@register(
    o.Chain()
    .view("ev_channels")
    .add("gappy", _GAPPY)
    .add("ranked", _RANKED)
    .add("least", "select min(n) as m from (select channel, count(*) as n from ranked group by channel)")
    .select("select series_id, channel, idx, value from ranked, least where idx < m")
)
def min_length_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.align_shortest(_gappy(spark, sf_dir))


@register(
    o.Chain()
    .view("ev_channels")
    .add("gappy", _GAPPY)
    .add("whole", "select idx from gappy group by idx having count(value) = 5")
    .add("ranked", _RANKED.replace("where value", "where idx in (from whole) and value"))
    .select("select series_id, channel, idx, value from ranked")
)
def row_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.align_shortest(_gappy(spark, sf_dir), by_row=True)


@register(
    """select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')
    and o_custkey in (select c_custkey from customer where c_nationkey in (1, 2, 3, 5, 8, 13))"""
)
def membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = v.table(spark, sf_dir, "customer").filter(F.col("c_nationkey").isin(1, 2, 3, 5, 8, 13))
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    kept = cl.members(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return cl.members(kept, "o_custkey", some.select(F.col("c_custkey").alias("o_custkey"))).drop("o_custkey")


@register(
    """select c_custkey, c_nationkey as n_nationkey, coalesce(n_name, c_nationkey::varchar) as n_name from customer
    left join (select * from nation where n_regionkey <> 2) on c_nationkey = n_nationkey"""
)
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = v.table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    codes = v.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return cl.lookup(codes, names, "n_nationkey", "n_name")


@register(
    """select label::varchar as series_id, row_number() over (partition by label order by vec_id, p) - 1 as idx, value from
    (select label, vec_id, unnest(range(64)) as p, unnest(embedding)::double as value from embeddings)"""
)
def array_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.table(spark, sf_dir, "embeddings").withColumn("series_id", F.col("label").cast("string"))
    return ch.flatten_arrays(df, SERIES, "vec_id", "embedding")


@register(
    f"""select vec_id, {o.r6('avg(x)')} as value from
    (select vec_id, unnest(embedding)::double as x from embeddings) group by vec_id
    union all select -1 - vec_id as vec_id, null as value from embeddings"""
)
def array_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    empty = df.select((-1 - F.col("vec_id")).alias("vec_id"), F.slice("embedding", 1, 0).alias("embedding"))
    return rounded(ch.array_mean(df.unionByName(empty), "embedding").select("vec_id", "value"), "value")


@register(
    o.Chain()
    .view("ev_channels")
    .add("const", "select series_id, 5 as channel, idx, 1.5::double as value from ev_channels where channel = 0")
    .add("six", "select series_id, channel, idx, value from ev_channels union all from const")
    .add("len", "select count(*) as m from ev_channels where channel = 2")
    .add("grid", "select channel, unnest(range(m)) as idx from (select distinct channel from six), len")
    .select(
        """select 'events' as series_id, g.channel, g.idx, coalesce(s.value, 0) as value
        from grid g left join six s on g.channel = s.channel and g.idx = s.idx"""
    )
)
def pad_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.ev_channels(spark, sf_dir)
    constant = df.select("series_id").distinct().withColumn("value", F.lit(1.5))
    six = ch.constant_channel(df, constant, 5)
    target = df.filter("channel = 2").groupBy("series_id").agg(F.count(F.lit(1)).alias("length"))
    return ch.pad_align(six, target)


@register(
    o.Chain()
    .view("li_flag")
    .add("n", "select series_id, count(*) as n from li_flag group by series_id")
    .add("pos", """select series_id, k, case when n <= 1000 then k when k = 999 then n - 1
        else floor(k * ((n - 1) / 999.0::double))::bigint end as idx
        from (select series_id, n, unnest(range(least(n, 1000))) as k from n)""")
    .select("select p.series_id, p.k as idx, v.value from pos p join li_flag v on p.series_id = v.series_id and p.idx = v.idx")
)
def downsample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.downsample(v.li_flag(spark, sf_dir), SERIES, 1000)


@register(o.Chain().view("li_flag").select("select series_id, idx, value from li_flag where idx < 6144"))
def head_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.head(v.li_flag(spark, sf_dir), WHOLE_HEAD)


_LONGEST = (
    o.Chain()
    .view("ev_channels")
    .add("n", "select series_id, channel, count(*) as n from ev_channels group by all having count(*) >= 100 and count(value) > 0")
    .add("best", "select * from n order by n desc, channel desc limit 1")
)


@register(_LONGEST.select("select series_id, channel, n from best"))
def longest_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.longest_channel(ch.valid_channels(v.ev_channels(spark, sf_dir), 100))


@register(
    _LONGEST.select(
        """select e.series_id, e.channel, idx, value from ev_channels e
        where not exists (select 1 from best b where b.channel = e.channel)"""
    )
)
def remaining_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.ev_channels(spark, sf_dir)
    return ch.other_channels(df, ch.longest_channel(ch.valid_channels(df, 100)))


def all_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of every view's series, each view standing for a family."""
    out = None
    for family, view in VIEW_FAMILIES.items():
        part = lengths(view(spark, sf_dir), SERIES).select(
            F.concat(F.lit(f"{family}:"), "series_id").alias("series_id"), F.lit(family).alias("family"), "n"
        )
        out = part if out is None else out.unionByName(part)
    return out


VIEW_FAMILIES = {"catalog": v.ev_type, "lines": v.ev_user, "pulsar": v.li_supp, "collision": v.li_flag, "bits": v.emb}
_VIEW_SQL = {"catalog": "ev_type", "lines": "ev_user", "pulsar": "li_supp", "collision": "li_flag", "bits": "emb"}


def all_lengths_chain() -> o.Chain:
    c = o.Chain()
    for name in _VIEW_SQL.values():
        c.view(name)
    return c.add(
        "lens",
        " union all ".join(
            f"select '{f}:' || series_id as series_id, '{f}' as family, count(*) as n from {t} group by series_id"
            for f, t in _VIEW_SQL.items()
        ),
    )


@register(
    all_lengths_chain().select(
        """select series_id, family, n from lens
        where n >= case family when 'lines' then 66 when 'pulsar' then 500 else 0 end"""
    )
)
def tci_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.register_series(all_lengths(spark, sf_dir), {"lines": 66, "pulsar": 500})


@register(
    o.Chain()
    .view("ev_type")
    .add("s", "select series_id, avg(value) as m, stddev_pop(value) as sd from ev_type group by series_id")
    .select(
        f"""select v.series_id, idx, {o.r6('ln(abs(value) + 1)')} as log_magnitude, {o.r6('value / sd')} as unit_std,
        {o.r6('(value - m) / (sd + 1e-10)')} as z_score from ev_type v join s on v.series_id = s.series_id"""
    )
)
def scalar_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.ev_type(spark, sf_dir)
    logs = cl.log_magnitude(df).withColumnRenamed("value", "log_magnitude")
    unit = cl.unit_std(df, SERIES).withColumnRenamed("value", "unit_std")
    z = cl.standardise(df, SERIES).withColumnRenamed("value", "z_score")
    out = logs.join(unit, ["series_id", "idx"]).join(z, ["series_id", "idx"])
    return rounded(out, "log_magnitude", "unit_std", "z_score")


@register(
    o.Chain().view("emb").select(
        f"""select series_id, {o.r6('stddev_pop(value)')} as std, stddev_pop(value) < 0.1 as low_variability
        from emb group by series_id"""
    )
)
def low_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cl.low_variability(v.emb(spark, sf_dir), SERIES, 0.1), "std")


# payloads of 0 to 32 characters
BITS = """with hex as (select lang, doc_id, left(md5(text), (doc_id % 33)::int) as h from documents),
    placed as (select lang, h, coalesce(sum(length(h)) over (partition by lang order by doc_id
        rows between unbounded preceding and 1 preceding), 0) as p from hex),
    chars as (select lang, p, unnest(range(length(h))) as c, unnest(string_split(h, '')) as ch from placed where h <> ''),
    vals as (select lang, p, c, ('0x' || ch)::int as x from chars),
    bits as (select lang as series_id, ((p + c) * 4 + b)::bigint as idx, ((x >> (3 - b)) & 1)::double as value
        from (select *, unnest(range(4)) as b from vals))"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.expr("left(md5(cast(text as binary)), cast(doc_id % 33 as int))")
    return v.table(spark, sf_dir, "documents").select("doc_id", "lang", payload.alias("hex"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.hex_bits(payloads(spark, sf_dir), "hex", ["doc_id"], "lang")


@register(BITS + " select series_id, idx, value from bits")
def hex_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bits(spark, sf_dir)


@register(
    BITS
    + f""" select series_id, idx, {o.r9('value + 1e-6 * ' + o.gaussian(o.key('jitter', 'series_id', 'idx')))} as value from bits"""
)
def bit_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.jitter(_bits(spark, sf_dir)).withColumn("value", F.round("value", 9))
