"""Purging, collecting orphans, re-embedding, guarding against a changed model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.config import KEEP_TIMINGS, PURGE_SECONDS


def purge(catalog: DataFrame, now: float, age: int = PURGE_SECONDS) -> DataFrame:
    """The catalogue without tombstones older than ``age``."""
    return catalog.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= now - age))


def referenced(contents: DataFrame, purged: DataFrame) -> DataFrame:
    """Rows whose content some remaining row still names, tombstoned or not. Purge first, then collect."""
    return contents.join(purged.where("content_hash is not null").select("content_hash").distinct(), "content_hash", "left_semi")


def orphans(contents: DataFrame, purged: DataFrame) -> DataFrame:
    return contents.join(purged.where("content_hash is not null").select("content_hash").distinct(), "content_hash", "left_anti")


def keep_recent(timings: DataFrame, keep: int = KEEP_TIMINGS) -> DataFrame:
    """Rows with an id of at least the largest less ``keep``."""
    top = timings.agg(F.max("id").alias("_top"))
    return timings.join(F.broadcast(top)).where(F.col("id") >= F.col("_top") - keep).drop("_top")  # one row is sent


def prune(catalog: DataFrame, contents: DataFrame, vectors: DataFrame, timings: DataFrame, now: float) -> dict[str, DataFrame]:
    kept = purge(catalog, now)
    return {"file_catalog": kept, "file_embedding": referenced(contents, kept), "vec_embedding": referenced(vectors, kept), "enrich_timing": keep_recent(timings)}


def reindex(contents: DataFrame, vectors: DataFrame, embed_column) -> tuple[DataFrame, DataFrame]:
    """(new vectors, one row failed): every stored text embedded again; where that fails the old vector stays.

    ``embed_column`` turns a text column into struct<embedding, error>. A model may be stamped only if failed is 0.
    """
    new = contents.select("content_hash", embed_column(F.col("extracted_text")).alias("e"))
    both = new.join(vectors.select("content_hash", F.col("embedding").alias("old")), "content_hash", "left")
    out = both.select("content_hash", F.coalesce("e.embedding", "old").alias("embedding"), F.col("e.error").alias("error"))
    return out.where("embedding is not null").select("content_hash", "embedding"), out.agg(F.count_if(F.col("error").isNotNull()).alias("failed"))


def model_matches(stamp: dict[str, str], model: str, dim: int, contents: DataFrame) -> bool:
    """Whether vectors of this model may be added: it is the stamped one, or nothing is stamped or stored yet."""
    known = stamp.get("embed_model")
    if known is None:
        return True
    return known == model and int(stamp.get("embed_dim", dim)) == dim or contents.isEmpty()
