"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests, a laptop) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(path)
        named = sc.getCheckpointDir()
    return named


#: Has a query's shuffle files removed from all executors when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write a table that is read from there on: the shuffles behind it are over and give their disk back at once, not when the driver collects garbage. by: columns whose values get folders of their own."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def checkpoint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Compute once and cut the lineage by a table in the shared folder: a lost executor costs nothing.

    Unlike a checkpoint of rows it is compressed, later reads take only the
    columns they need, and its size is known to the optimizer. by: columns (the
    last ones) whose values get folders of their own, so that a filter on them
    reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    write(df, path, by)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that checkpoint() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_table_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one or two longs that may be broadcast: 4 MB at most.
SLIM_ROWS = 250_000


def slim(df: DataFrame) -> DataFrame:
    """df, a checkpointed table of one or two longs, with a broadcast hint if a count proves it small; beyond that Spark decides by its size."""
    return F.broadcast(df) if df.count() <= SLIM_ROWS else df
