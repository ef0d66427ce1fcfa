"""Reading tables and keeping intermediate ones."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A session on one machine that names none (tests) gets a temporary folder,
    which is removed when the process ends; on a cluster that is an error, as
    executors would each write to their own disk.
    """
    base = spark.sparkContext.getConf().get(_SETTING, None) or spark.conf.get(_SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def keep(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table into the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of any executor
    without going back further than this table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """A join side marked for broadcast if it has at most ``limit`` rows; beyond, it is joined by shuffle.

    ``rows`` is a counted bound; the rows are assumed to be a few numbers wide.
    """
    return F.broadcast(df) if rows <= limit else df


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows with the smallest hashes of the key, the same ones at every partitioning.

    Only hashes go to one task, never the rows; the rows are then filtered in place.
    """
    h = F.xxhash64(key)
    cut = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.limit(0) if cut is None else df.where(h <= cut)
