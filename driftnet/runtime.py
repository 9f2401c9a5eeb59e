"""Session-level helpers shared by every operator: table access, shared storage, partition spread."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none and all tasks run in this process (tests, a single machine) is a temporary folder chosen
    and set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors reach in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="driftnet-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone; the folder then stays for its owner to clear
        pass


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage when the process ends."""
    atexit.register(_drop, spark, path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Parquet, not a checkpoint file, so that later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftnet/{name}-{uuid.uuid4().hex}"
    # once the table stands nobody reads the shuffles it was made from: their files go with the run, not with a later collection
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    files = df.inputFiles()
    if files:
        _drop(df.sparkSession, files[0].rsplit("/", 1)[0])


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition a core before Python work; no-op once the input is large. What comes out of a
    shuffle is left alone: it is spread already, and asking for its partitions would run it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = " ".join(m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*(\w+)", line)))  # operators, not the names they hold
    if any(x in nodes for x in ("Aggregate", "Join", "Sort", "Repartition", "Window", "Distinct", "Limit")):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def day_of(epoch) -> F.Column:
    """Calendar day (UTC) of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
