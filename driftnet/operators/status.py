"""Counts and estimates over catalogue and timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.config import RATE_ROWS, STATUSES, Config
from driftnet.functions import columns as C

#: The timing rows that a phase's rate is measured by.
RATE_KINDS = {"document": ("document",), "image_meta": ("image",), "audio": ("audio", "video"), "image_caption": ("image",)}


def status_counts(catalog: DataFrame) -> DataFrame:
    """Live rows by status; every status has a row."""
    n = catalog.where(C.live(F.col("deleted_at"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    all_ = catalog.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return all_.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def folder_share(catalog: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Live rows below each folder and their share of all in percent; folders without rows are left out, overlapping ones count twice.
    One pass: a count for each folder."""
    live = catalog.where(C.live(F.col("deleted_at")))
    counts = live.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(C.under_any(F.col("path"), [f])).alias(f"f{i}") for i, f in enumerate(folders)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("folder"), F.col(f"f{i}").alias("n")) for i, f in enumerate(folders)]))
    out = counts.select("total", rows.alias("r")).where("r.n > 0")
    share = 100.0 * F.col("r.n") / F.col("total")
    return out.select("r.folder", "r.n", F.round(share, 6).alias("share"), (share >= 50).alias("dominant"))


def kind_counts(catalog: DataFrame, cfg: Config | None = None) -> DataFrame:
    return catalog.where(C.live(F.col("deleted_at"))).groupBy(C.kind_of(F.col("ext"), cfg).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def caption_queue_rows(catalog: DataFrame, contents: DataFrame) -> DataFrame:
    """Live files of contents that await a caption: one row a content and live path."""
    waiting = contents.where("source_kind = 'image_meta'").select("content_hash")
    return catalog.where(C.live(F.col("deleted_at"))).join(waiting, "content_hash")


def pending_by_phase(catalog: DataFrame, contents: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Backlog of each phase in phase order: phase, place, n. One pass over the catalogue for the file phases."""
    cfg = cfg or Config()
    phases = ("document", "image_meta", "audio")
    rows = catalog.where(C.live(F.col("deleted_at")) & (F.col("status") == "pending"))
    counts = rows.agg(*[F.count_if(F.col("ext").isin(sorted(cfg.phase_ext(p)))).alias(p) for p in phases])
    files = counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(i).alias("place"), F.col(p).alias("n")) for i, p in enumerate(phases)])).alias("r")).select("r.*")
    captions = caption_queue_rows(catalog, contents).agg(F.lit("image_caption").alias("phase"), F.lit(3).alias("place"), F.count(F.lit(1)).alias("n"))
    return files.unionByName(captions)


def next_phase(backlog: DataFrame) -> str | None:
    """The first phase in order that has work."""
    row = backlog.where("n > 0").orderBy("place").first()
    return row["phase"] if row else None


def seconds_per_file(timings: DataFrame, phase: str, rows: int = RATE_ROWS) -> DataFrame:
    """One row, seconds: total time over files hashed in the latest rows of the phase's kinds; null where nothing is known."""
    recent = timings.where(F.col("source_kind").isin(*RATE_KINDS.get(phase, ()))).orderBy(F.desc("id"), "stage", "seconds").limit(rows)
    agg = recent.agg(F.sum("seconds").alias("total"), F.count_if(F.col("stage") == "hash").alias("files"))
    return agg.select(F.when((F.col("files") > 0) & (F.col("total") > 0), F.col("total") / F.col("files")).alias("seconds"))


def backlog_estimate(catalog: DataFrame, contents: DataFrame, timings: DataFrame, phase: str, cfg: Config | None = None) -> DataFrame:
    """phase, n, seconds (for all of it), days at the daily budget."""
    cfg = cfg or Config()
    n = pending_by_phase(catalog, contents, cfg).where(F.col("phase") == phase)
    rate = seconds_per_file(timings, phase)
    work = F.col("n") * F.col("seconds")
    return n.join(F.broadcast(rate)).select("phase", "n", F.round(work, 4).alias("work_seconds"), F.round(work / cfg.daily_budget_seconds, 6).alias("days"))


def timing_by_stage(timings: DataFrame) -> DataFrame:
    return timings.groupBy("source_kind", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"), F.max("seconds").alias("slowest"))
