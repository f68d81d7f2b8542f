"""Sources on files written by the test."""

import json
import time

import pytest
from pyspark.sql import functions as F

from scalefold import config as cfg
from scalefold.functions import numeric as nu
from scalefold.functions.draws import permuted
from scalefold.operators import channels as ch
from scalefold.operators import cleaning as cl
from scalefold.sources import series as ss
from scalefold.sources import text as st
from scalefold.streaming import payloads as sp
from tests.conftest import by_series


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_dirty_csv(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'intens,wn(cm-1),note\n="1.5",100,x\n# a comment line\n3,200,y,too many\n nan ,"300",\n4\nnan,,\n',
    )
    rows = st.read_dirty_csv(spark, path).select("intens", "wn(cm-1)").collect()
    # the line with a field too many is gone though its extra column is not selected
    assert [tuple(r) for r in rows] == [('="1.5"', "100"), (" nan ", "300"), ("4", None), (None, None)]
    values = st.read_dirty_csv(spark, path).select(nu.parse_number(F.col("intens"))).collect()
    assert [r[0] for r in values] == [1.5, None, 4.0, None]


def test_dirty_csv_short_variant(spark, tmp_path):
    path = write(tmp_path / "b.csv", "element,intens\n#H,1\nH, \nHe,nan\n")
    rows = st.read_dirty_csv(spark, path, na_tokens=nu.NA_TOKENS_SHORT, comment=None).select("element", "intens").collect()
    assert [tuple(r) for r in rows] == [("#H", "1"), ("H", " "), ("He", None)]


@pytest.mark.parametrize(
    "text, want",
    [('="1.5"', 1.5), ("' 3.25 '", 3.25), ("nan", None), ("", None), ("1d", None), ("Infinity", None), ("-2e3", -2000.0), ("1e999", None)],
)
def test_parse_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(nu.parse_number(F.col("t"))).first()[0] == want


def test_positional_tsv(spark, tmp_path):
    lines = [f"header {i}" for i in range(5)]
    lines += ["\t".join([str(i), str(i * 0.5), "bad" if i == 3 else str(-i)]) for i in range(400)]
    lines[10] += "\textra"  # more fields than the first data line: skipped
    path = write(tmp_path / "g.tsv", "\n".join(lines) + "\n")
    df = st.read_positional_tsv(spark, path, {"a": 1, "b": 2, "c": 7}, skip=5, rows=100)
    rows = df.orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(100))
    kept = [i for i in range(400) if i != 5][:100]
    assert [r["a"] for r in rows] == [i * 0.5 for i in kept]
    assert rows[3]["b"] is None and rows[4]["b"] == -4.0 and rows[0]["c"] is None


def test_positional_tsv_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "big.tsv", "\n".join(f"{i}\t{i}" for i in range(20_000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = st.read_positional_tsv(spark, path, {"v": 1}, skip=257, rows=15_000)
        assert df.filter("v <> row + 257").count() == 0 and df.count() == 15_000
        got = by_series(st.read_whitespace_column(spark, path).withColumnRenamed("file", "series_id"))
        assert list(got.values())[0] == [float(i) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_whitespace_column(spark, tmp_path):
    path = write(tmp_path / "r.res", "# mjd res\n 1.0   0.5 9\n\n2.0\tx\n3.0 -1e-6 # tail\n4.0\n")
    rows = st.read_whitespace_column(spark, path).orderBy("idx").collect()
    assert [(r["idx"], r["value"]) for r in rows] == [(0, 0.5), (1, -1e-6)]


def test_first_match(spark, tmp_path):
    path = write(tmp_path / "n.txt", "other 7\nlog10_EQUAD -6.5 x\nEFAC 1.1\n")
    assert [r["value"] for r in st.read_first_match(spark, path).collect()] == [-6.5]


def test_first_available(spark):
    full = spark.createDataFrame([("a", 1.0)], "k string, v double")
    avg = spark.createDataFrame([("a", 9.0), ("b", 2.0)], "k string, v double")
    rows = st.first_available([full, avg], ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, 0), ("b", 2.0, 1)]


def test_files_dates_and_pruning(spark, tmp_path):
    write(tmp_path / "tim" / "J1713+0747_PINT_20220309.nb.tim", "x")
    files = st.list_files(spark, str(tmp_path), "*.nb.tim")
    names = spark.createDataFrame([("J1713+0747",), ("B1855+09",)], "series_id string")
    got = {r[0]: r[1] for r in st.file_dates(names, files).collect()}
    assert got == {"J1713+0747": "20220309", "B1855+09": cfg.PULSAR_DATE}
    wanted = spark.createDataFrame([("J1713+0747_PINT_20220309.nb.tim",), ("gone",)], "name string")
    assert st.existing(wanted, files).count() == 1


def test_hex_bits(spark):
    df = spark.createDataFrame([(1, "0F"), (0, "a3")], "n int, qrn string")
    got = by_series(ss.hex_bits(df, "qrn", ["n"]))["bits"]
    assert got == [1, 0, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1]


def test_payload_starts_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "f" * (1 + i % 5)) for i in range(57)], "n int, qrn string")
    whole = ss.hex_bits(df, "qrn", ["n"]).agg(F.max("idx"), F.count_distinct("idx")).first()
    monkeypatch.setattr(ss, "START_BLOCK", 10)
    parts = ss.hex_bits(df, "qrn", ["n"]).agg(F.max("idx"), F.count_distinct("idx")).first()
    total = 4 * sum(1 + i % 5 for i in range(57))
    assert tuple(whole) == tuple(parts) == (total - 1, total)


def test_long_payloads_take_time_as_their_length(spark):
    """Also with characters of several bytes, which count once; a text of 60,000 characters took a minute when each was counted from its start."""
    long = "0f\u00e9\n" * 15_000
    df = spark.createDataFrame([(0, long), (1, "a3"), (2, ""), (3, "f" * ss.PIECE), (4, "1" * (ss.PIECE + 1))], "n int, qrn string")
    begun = time.monotonic()
    got = ss.hex_bits(df, "qrn", ["n"]).toPandas().sort_values("idx")
    assert time.monotonic() - begun < 20
    chars = "0f00" * 15_000 + "a3" + "f" * ss.PIECE + "1" * (ss.PIECE + 1)
    assert got["idx"].tolist() == list(range(4 * len(chars)))
    assert got["value"].tolist() == [float(int(c, 16) >> b & 1) for c in chars for b in (3, 2, 1, 0)]


def test_payload_files_as_a_stream(spark, tmp_path):
    land = tmp_path / "in"
    write(land / "p1.json", json.dumps({"qrn": "a3"}) + "\n" + json.dumps({"other": 1}) + "\n")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sp.land_payloads(spark, str(land), out, state)
    write(land / "p2.json", json.dumps({"qrn": "0f"}) + "\n")
    sp.land_payloads(spark, str(land), out, state)
    batch = ss.read_payloads(spark, str(land))
    assert sorted(r[0] for r in spark.read.parquet(out).select("qrn").collect()) == ["0f", "a3"]
    assert batch.count() == 2


def test_streamed_bits_are_batch_bits(spark, tmp_path):
    """Two starts over one checkpoint, several files and micro-batches, series that share files, lines without a payload."""
    land = tmp_path / "in"
    said = {
        "f1": [("a", "0F"), ("b", "a3"), ("a", "1")],
        "f2": [("b", ""), (None, "ff"), ("a", "77")],
        "f3": [("b", "c0ffee")],
        "f4": [("a", None), ("b", "9")],
    }
    args = str(land), str(tmp_path / "out"), str(tmp_path / "state")

    def drop(*names):
        for name in names:
            write(land / f"{name}.json", "not json\n" + "".join(json.dumps({"who": w, "qrn": h}) + "\n" for w, h in said[name]))

    drop("f1", "f2", "f3")
    first = by_series(sp.stream_bits(spark, *args, series="who", order=["file"], batch_files=1 << 10))
    again = by_series(sp.stream_bits(spark, *args, series="who", order=["file"]))  # nothing new: nothing is written twice
    assert first == again
    drop("f4")
    (land / "f0.json").write_text("")  # empty, and by its name before all others
    got = by_series(sp.stream_bits(spark, *args, series="who", order=["file"]))
    rows = [(i, w, h) for i, (w, h) in enumerate(x for f in said.values() for x in f) if w and h is not None]
    whole = by_series(ss.hex_bits(spark.createDataFrame(rows, "n int, who string, qrn string"), "qrn", ["n"], "who"))
    assert got == whole and {k: v[: len(first[k])] for k, v in got.items()} == first


def test_late_and_repeated_payload_files(spark, tmp_path):
    """A late file goes behind those placed before it; a file written again under its name is not read again."""
    land = tmp_path / "in"
    args = str(land), str(tmp_path / "out"), str(tmp_path / "state")
    write(land / "m.json", json.dumps({"qrn": "f"}) + "\n")
    sp.stream_bits(spark, *args, order=["file"])
    write(land / "a.json", json.dumps({"qrn": "2"}) + "\n")
    write(land / "m.json", json.dumps({"qrn": "000"}) + "\n")
    assert by_series(sp.stream_bits(spark, *args, order=["file"]))["bits"] == [1, 1, 1, 1, 0, 0, 1, 0]


def test_one_file_a_micro_batch(spark, tmp_path):
    land = tmp_path / "in"
    for i in range(5):
        write(land / f"p{i}.json", json.dumps({"qrn": "f" * i + "0"}) + "\n")
    bits = sp.stream_bits(spark, str(land), str(tmp_path / "out"), str(tmp_path / "state"), batch_files=1)
    assert bits.count() == 4 * sum(i + 1 for i in range(5)) == bits.select("idx").distinct().count()


def test_jitter_is_small_and_repeatable(spark, samples):
    a, b = by_series(ss.jitter(samples)), by_series(ss.jitter(samples.repartition(3)))
    assert a == b
    base = by_series(samples)
    d = [x - y for x, y in zip(a["long"], base["long"])]
    assert 0.9e-6 < (sum(v * v for v in d) / len(d)) ** 0.5 < 1.1e-6


def test_column_subset_and_catalog(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(50).selectExpr("id", "double(id) as FLUX_Z", "double(-id) as FLUX_G", "1.0D as FLUX_R", "'x' as junk").write.parquet(path)
    df = ss.read_columns(spark, path, cfg.CATALOG_COLUMNS, "sky", "id")
    assert df.count() == 150
    assert "junk" not in df._jdf.queryExecution().executedPlan().toString()
    catalog = cfg.dataset_catalog(spark)
    assert catalog.count() == 11 + 63 + 83
    assert ss.enabled(catalog).count() == 2 + 63 + 30
    assert cfg.dataset_config(spark).count() == catalog.count()


@pytest.mark.parametrize("task_rows", [0, 1_000_000])
def test_positional_zip(spark, task_rows):
    """Unequal lengths, ties, repeated rows and NULLs."""
    files = spark.createDataFrame([("b", 2), ("a", 1), (None, 9), ("b", 1), ("b", 2)], "file string, part int").repartition(3)
    names = spark.createDataFrame([("n2",), ("n1",), ("n3",)], "name string")
    short = ss.zip_listings(files, names, ["file"], ["name"], task_rows=task_rows).orderBy("pos").collect()
    assert [tuple(r) for r in short] == [(0, None, 9, "n1"), (1, "a", 1, "n2"), (2, "b", 1, "n3")]
    whole = ss.zip_listings(files, names, ["file"], ["name"], pad=True, task_rows=task_rows).orderBy("pos").collect()
    assert [tuple(r) for r in whole[3:]] == [(3, "b", 2, None), (4, "b", 2, None)]
    assert ss.zip_listings(files.limit(0), names, ["file"], ["name"], task_rows=task_rows).count() == 0


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 100, 1001):
        df = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
        got = [r[0] for r in df.select(permuted(F.col("id"), F.col("n"), 5, "test", F.lit("s"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != list(range(n)))

def test_landed_samples(spark, samples, tmp_path):
    samples.write.parquet(str(tmp_path / "s"))
    assert ss.read_samples(spark, str(tmp_path / "s")).count() == samples.count()


def test_cleaning_chain(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", i, v) for i, v in enumerate([1.0, nan, inf, -inf, 3.0, 100.0])]
    df = spark.createDataFrame(rows, "series_id string, idx bigint, value double")
    assert by_series(cl.median_impute(df, ["series_id"]))["a"] == [1.0, 3.0, 3.0, 3.0, 3.0, 100.0]
    gone = cl.drop_null_columns(spark.createDataFrame([(1, None), (2, None)], "a int, b string"))
    assert gone.columns == ["a"]


def test_jagged_arrays(spark):
    df = spark.createDataFrame([("e", 0, [1.0, 2.0]), ("e", 1, []), ("e", 2, [3.0])], "series_id string, row int, pt array<double>")
    assert by_series(ch.flatten_arrays(df, ["series_id"], "row", "pt"))["e"] == [1.0, 2.0, 3.0]
    means = [r["value"] for r in ch.array_mean(df, "pt").orderBy("row").collect()]
    assert means == [1.5, None, 3.0]


def test_longest_channel_tie(spark):
    n = spark.createDataFrame([("s", 0, 5), ("s", 1, 5), ("s", 2, 5)], "series_id string, channel int, n bigint")
    assert ch.longest_channel(n).first()["channel"] == 2
