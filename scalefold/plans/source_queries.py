"""Text sources, column scans, landed samples and listings: files are written from the tables, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scalefold.functions.numeric import parse_number
from scalefold.operators.export import write_csv
from scalefold.plans import oracle as o
from scalefold.plans import views as v
from scalefold.plans.clean_queries import BITS, payloads
from scalefold.plans.registry import register
from scalefold.session import run_dir
from scalefold.sources import series as ss
from scalefold.sources import text as st
from scalefold.streaming.payloads import stream_bits

#: Samples a written file holds: a long series is several files.
FILE_ROWS = 20_000


def _path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event series as lines to be: ``file`` and ``pos`` in it, with ``value`` as text."""
    rows = v.ev_type(spark, sf_dir)
    file = F.concat_ws("-", "series_id", F.expr(f"idx div {FILE_ROWS}"))
    return rows.select(file.alias("file"), F.pmod("idx", F.lit(FILE_ROWS)).alias("pos"), F.col("value").cast("string").alias("value"), "series_id")


_FILES = f"select series_id || '-' || (idx // {FILE_ROWS})::varchar as file, idx % {FILE_ROWS} as pos, value, series_id from ev_type"


def _written(lines: DataFrame, label: str) -> str:
    """Write ``lines(file, pos, line)``, each file in the order of ``pos``; a file is one task's."""
    path = _path(lines.sparkSession, label)
    ordered = lines.repartition("file").sortWithinPartitions("file", "pos")
    ordered.select("file", "line").write.partitionBy("file").text(path)
    return path


def _file_name() -> Column:
    return F.regexp_extract("file", "file=([^/]+)/", 1).alias("file")


@register(
    o.Chain().view("ev_type").add("f", _FILES).select(
        """select file, pos, case when pos % 7 <> 2 then value end as value, case when pos % 13 <> 5 then series_id end as note
        from f where pos % 11 <> 3"""
    )
)
def dirty_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null tokens, wrapped numbers, comments, short lines and lines with too many fields."""
    pos = F.col("pos")
    value = F.when(pos % 7 == 2, F.element_at(F.array(F.lit("nan"), F.lit("NaN"), F.lit("")), (pos % 3 + 1).cast("int"))).otherwise(
        F.when(pos % 4 == 1, F.concat(F.lit("="), "value")).otherwise(F.col("value"))
    )
    note = F.when((pos % 13 == 5) & (pos % 11 != 3), "").otherwise(F.concat(F.lit(","), "series_id"))
    extra = F.when(pos % 11 == 3, ",more").otherwise("")
    rows = _files(spark, sf_dir).select("file", "pos", F.concat(pos.cast("string"), F.lit(","), value, note, extra).alias("line"))
    comments = rows.filter("pos % 17 = 0").withColumn("line", F.concat(F.lit("# "), "line"))
    header = rows.filter("pos = 0").select("file", F.lit(-1).cast("bigint").alias("pos"), F.lit("at,number,note").alias("line"))
    path = _written(rows.unionByName(comments).unionByName(header), "csv")
    got = st.read_dirty_csv(spark, path, ["at", "number", "note"])
    return got.select(_file_name(), F.col("at").cast("bigint").alias("pos"), parse_number(F.col("number")).alias("value"), "note")


@register(
    o.Chain().view("ev_type").add("f", _FILES).select(
        """select file, row_number() over (partition by file order by pos) - 1 as row, pos::double as at, value from f where pos % 9 <> 4"""
    )
)
def positional_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines ahead of the data, fields by position, wider lines left out."""
    rows = _files(spark, sf_dir)
    tail = F.when(F.col("pos") % 9 == 4, "\tmore").otherwise("")
    line = F.concat(F.lit("x\t"), F.col("pos").cast("string"), F.lit("\ty\t"), "value", tail)
    ahead = rows.filter("pos = 0").select("file", F.explode(F.sequence(F.lit(-3).cast("bigint"), F.lit(-1).cast("bigint"))).alias("pos"), F.lit("ahead\tof\tthe\tdata\tx").alias("line"))
    path = _written(rows.select("file", "pos", line.alias("line")).unionByName(ahead), "tsv")
    got = st.read_positional_tsv(spark, path, {"at": 1, "value": 3}, skip=3)
    return got.select(_file_name(), "row", "at", "value")


@register(
    o.Chain().view("ev_type").add("f", _FILES).select(
        "select file, row_number() over (partition by file order by pos) - 1 as idx, value from f where pos % 10 <> 3"
    )
)
def whitespace_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the second field; comments, empty lines and words are no samples."""
    rows = _files(spark, sf_dir)
    value = F.when(F.col("pos") % 10 == 3, "none").otherwise(F.col("value"))
    line = F.concat(F.lit("  "), F.col("pos").cast("string"), F.lit(" \t "), value, F.lit("  # read"))
    noise = rows.filter("pos % 20 = 0").select("file", "pos", F.explode(F.array(F.lit(""), F.lit("# 1 2 3"))).alias("line"))
    path = _written(rows.select("file", "pos", line.alias("line")).unionByName(noise), "columns")
    return st.read_whitespace_column(spark, path).select(_file_name(), "idx", "value")


@register(o.Chain().view("ev_type").add("f", _FILES).select("select file, value from f where pos = 10"))
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of many noise lines of a file the first one counts."""
    rows = _files(spark, sf_dir)
    word = F.when(F.col("pos") % 50 == 10, "EQUAD ").when(F.col("pos") % 50 == 30, "  EFAC\t").otherwise("at ")
    path = _written(rows.select("file", "pos", F.concat(word, "value").alias("line")), "pairs")
    return st.read_first_match(spark, path).select(_file_name(), "value")


@register(
    o.Chain().view("ev_type").add("f", _FILES).select(
        """select file, case when series_id = 'click' then 1 else 0 end as priority, pos, case when series_id = 'click' then -value else value end as value
        from f where pos % 10 <> 3"""
    )
)
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean samples where the first source has the file, else those of the second."""
    rows = _files(spark, sf_dir).filter("pos % 10 <> 3").select("file", "pos", F.col("value").cast("double").alias("value"), "series_id")
    there = rows.filter("series_id <> 'click'").drop("series_id")
    other = rows.drop("series_id").withColumn("value", -F.col("value"))
    return st.first_available([there, other], ["file"]).select("file", "priority", "pos", "value")


@register(
    o.Chain().view("ev_type").add("f", _FILES).select(
        "select distinct series_id, file, case when series_id = 'view' then 'none' else series_id end as part from f where series_id <> 'error'"
    )
)
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by name, a part of the name with its default, series without a file left out."""
    lines = _files(spark, sf_dir).filter("series_id <> 'error'")
    path = _written(lines.select("file", "pos", F.col("value").alias("line")), "listing")
    found = st.list_files(spark, path, "part-*").select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"))
    listed = found.distinct().withColumn("name", F.regexp_extract("file", "^(.*)-", 1))
    config = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    part = st.name_part(F.regexp_replace("file", "^view", "_"), "^([a-z]+)-", "none").alias("part")
    return st.existing(config, listed).join(listed, "name").select(F.col("name").alias("series_id"), "file", part)


@register(
    """select 'events' as series_id, channel, row_number() over (partition by channel order by event_id) - 1 as idx, value from (
        select event_id, 0 as channel, value from events union all select event_id, 1, user_id::double from events)"""
)
def column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numeric columns of a wide table as channels."""
    return ss.read_columns(spark, f"{sf_dir.rstrip('/')}/events.parquet", ["value", "user_id"], "events", "event_id")


@register(o.Chain().view("li_supp").select("select series_id, idx, value from li_supp"))
def landed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long table of samples, written and scanned."""
    path = _path(spark, "samples")
    v.li_supp(spark, sf_dir).write.parquet(path)
    return ss.read_samples(spark, path)


@register(o.Chain().view("li_supp").select("select series_id, idx, value from li_supp"))
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: rows written as CSV and read back."""
    path = _path(spark, "flat")
    write_csv(v.li_supp(spark, sf_dir), path)
    return spark.read.option("header", True).schema("series_id string, idx bigint, value double").csv(path)


@register(
    """select coalesce(s.pos, c.pos) as pos, coalesce(s_suppkey, -1) as s_suppkey, coalesce(c_custkey, -1) as c_custkey from
        (select s_suppkey, s_acctbal, row_number() over (order by s_acctbal nulls first, s_suppkey) - 1 as pos from supplier) s full join
        (select c_custkey, c_acctbal, row_number() over (order by c_acctbal nulls first, c_custkey) - 1 as pos from customer) c on s.pos = c.pos"""
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of unequal length side by side."""
    suppliers = v.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    customers = v.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    paired = ss.zip_listings(suppliers, customers, ["s_acctbal"], ["c_acctbal"], pad=True)
    # whole-number columns without NULLs read the same everywhere
    return paired.select("pos", "s_suppkey", "c_custkey").fillna(-1)


@register(
    BITS
    + """ select series_id, count(*) as n_bits, cast(sum(value) as bigint) as n_ones, max(idx) as last_idx,
        cast(sum(idx) as bigint) as idx_sum from bits where series_id is not null group by series_id"""
)
def hex_bits_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 over files that arrive in two drops, each taken in by a start of its own: positions go on where the first drop ended.

    Files come in bounded micro-batches in the order of arrival, so what does not depend on it is compared: every position from 0 once, and the ones.
    """
    source, target, state = (_path(spark, label) for label in ("payloads", "bits", "state"))
    docs = payloads(spark, sf_dir)
    for drop in (0, 1):
        lines = docs.filter(F.pmod("doc_id", F.lit(2)) == drop)
        said = lines.select(F.to_json(F.struct("lang", F.col("hex").alias("qrn"))).alias("line"))
        said.write.option("maxRecordsPerFile", FILE_ROWS).text(f"{source}/drop={drop}")
        bits = stream_bits(spark, f"{source}/*", target, state, "lang")
    return bits.groupBy("series_id").agg(
        F.count("*").alias("n_bits"), F.sum("value").cast("bigint").alias("n_ones"),
        F.max("idx").alias("last_idx"), F.sum("idx").alias("idx_sum"),
    )
