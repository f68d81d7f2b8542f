"""Session defaults and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Shuffle partitions are left to the cluster; AQE coalesces them downwards.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a few bytes of samples mean much arithmetic: keep a partition per core before growing partitions
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "scalefold", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants, held in the plan itself: no Python task reads it and its size is known."""
    kinds = T.StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.names), schema=kinds)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a ``local`` master may go on without the setting: there a fresh
    temporary folder is shared by all tasks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="scalefold-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/scalefold-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables this application has landed; call it when their results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def land(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the application's folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and gives
    later stages column pruning and real table statistics. ``release`` removes the tables. ``compression``
    names a Parquet codec where the session's own is not wanted.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
