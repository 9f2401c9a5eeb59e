"""Folding a directory walk into the catalogue: one full outer join, one new snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.config import Config
from driftnet.functions import columns as C


def diff(catalog: DataFrame, walk: DataFrame, roots: Sequence[str], now: float, cfg: Config | None = None) -> DataFrame:
    """Every catalogue row and every new path, with the ``action`` the walk calls for; columns of the catalogue and action.

    Actions: added, changed, requeued (a failed file below the retry cap), seen, tombstoned (live, below a root that was walked,
    not seen), gone (tombstoned before) and outside (not below a walked root). Only roots that could be read may be given:
    an unreadable root means unknown, never deleted. ``walk`` has path, size_bytes, mtime, renamed; a path that comes twice counts once.
    """
    cfg = cfg or Config()
    w = walk.groupBy("path").agg(F.max(F.struct("mtime", "size_bytes", "renamed")).alias("w"))
    w = w.select(F.col("path").alias("w_path"), F.col("w.size_bytes").alias("w_size"), F.col("w.mtime").alias("w_mtime"), F.col("w.renamed").alias("w_renamed"))
    j = catalog.join(w, F.col("path") == F.col("w_path"), "full")
    new, unseen = F.col("path").isNull(), F.col("w_path").isNull()
    changed = ~(F.col("size_bytes").eqNullSafe(F.col("w_size")) & F.col("mtime").eqNullSafe(F.col("w_mtime")))
    requeue = (F.col("status") == "failed") & (F.col("retry_count") < cfg.max_enrich_retries)
    below = C.under_any(F.col("path"), roots)
    action = (
        F.when(new, "added").when(unseen & ~below, "outside").when(unseen & F.col("deleted_at").isNotNull(), "gone").when(unseen, "tombstoned")
        .when(changed, "changed").when(requeue, "requeued").otherwise("seen")
    )
    j = j.withColumn("action", action)
    name = C.file_name(F.col("w_path"))
    ext = C.extension(name)
    kind = C.kind_of(ext, cfg)
    fresh = F.when(F.coalesce(F.col("w_renamed"), F.lit(0)) == 1, "skipped").when(kind == "unsupported", "unsupported").otherwise("pending")
    a = F.col("action")
    anew, taken = a.isin("added", "changed"), a.isin("added", "changed", "requeued", "seen")
    return j.select(
        "id", F.coalesce("path", "w_path").alias("path"), F.when(a == "added", name).otherwise(F.col("filename")).alias("filename"),
        F.when(a == "added", ext).otherwise(F.col("ext")).alias("ext"), F.when(anew, F.col("w_size")).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(anew, F.col("w_mtime")).otherwise(F.col("mtime")).alias("mtime"), F.when(~anew, F.col("content_hash")).alias("content_hash"),
        F.when(anew, fresh).when(a == "requeued", "pending").otherwise(F.col("status")).alias("status"), F.when(~anew, F.col("error_reason")).alias("error_reason"),
        F.when(anew, 0).otherwise(F.col("retry_count")).alias("retry_count"), F.when(a != "added", F.col("last_attempt")).alias("last_attempt"),
        F.when(a == "added", now).otherwise(F.col("first_seen")).alias("first_seen"), F.when(taken, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(a == "tombstoned", now).when(taken, None).otherwise(F.col("deleted_at")).alias("deleted_at"), "action",
    )


def number_added(changes: DataFrame) -> DataFrame:
    """Ids for added rows, above the largest there is; numbered within hash buckets, so no task holds all of them."""
    spark = changes.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = changes.where("id is null").withColumn("_b", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    sizes = added.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    starts = sizes.select("_b", before.alias("_before"))
    top = changes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("path"))
    numbered = added.withColumn("_r", rank).join(F.broadcast(starts), "_b").join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_before") + F.col("_r"))
    return changes.where("id is not null").unionByName(numbered.drop("_b", "_r", "_before", "_top"))


def stats(changes: DataFrame) -> DataFrame:
    """One row: seen, added, updated (rows that were there and were seen), tombstoned."""
    n = lambda *actions: F.count_if(F.col("action").isin(*actions))
    return changes.agg(n("added", "changed", "requeued", "seen").alias("seen"), n("added").alias("added"), n("changed", "requeued", "seen").alias("updated"), n("tombstoned").alias("tombstoned"))


def apply(catalog: DataFrame, walk: DataFrame, roots: Sequence[str], now: float, cfg: Config | None = None) -> DataFrame:
    """The next snapshot of the catalogue."""
    return number_added(diff(catalog, walk, roots, now, cfg)).select(*catalog.columns)
