"""Crawls as a stream: walk listings that arrive as files are folded into the catalogue, each micro-batch one snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from driftnet.config import Config
from driftnet.operators import crawl
from driftnet.operators.store import Store
from driftnet.schema import TIMING, WALK


def fold_listings(spark: SparkSession, store: Store, listings: str, roots: Sequence[str], now: float, checkpoint: str, cfg: Config | None = None):
    """Take in every walk listing (parquet of path, size_bytes, mtime, renamed) that arrived since the last call.

    One listing file is one whole walk and one micro-batch. The manifest keeps the last batch's number with its tables, so a batch that
    is delivered again after a crash changes nothing.
    """

    def fold(walked: DataFrame, batch_id: int) -> None:
        if int(store.meta().get("crawl_batch", -1)) >= batch_id:
            return
        store.publish({"file_catalog": crawl.apply(store.read("file_catalog"), walked, roots, now, cfg)}, {"crawl_batch": batch_id})

    stream = spark.readStream.schema(WALK).option("maxFilesPerTrigger", 1).parquet(listings)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timing_rates(spark: SparkSession, folder: str, delay: str = "3 days"):
    """Streaming counts and seconds by kind, stage and hour; rows delivered twice count once, later than ``delay`` are dropped
    by the watermark."""
    from pyspark.sql import functions as F

    rows = spark.readStream.schema(TIMING).parquet(folder).withColumn("ts", F.timestamp_seconds("at"))
    once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("ts", "1 hour").alias("hour"), "source_kind", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))
