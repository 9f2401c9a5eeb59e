"""From pending files to contents and vectors: queues, outcomes, captions, and the guards between batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.config import STREAK_LIMIT, Config
from driftnet.functions import columns as C
from driftnet.operators.status import caption_queue_rows

#: Reasons that blame the model, not the file.
MODEL_FAILURES = ("embed failed", "caption failed", "transcribe failed")


class Budget:
    """Seconds that may be spent, read between batches; rounded to hundredths."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.total, self.clock, self.start, self.extra = float(seconds), clock, clock(), 0.0

    def remaining(self) -> float:
        return max(0.0, round(self.total - (self.clock() - self.start) - self.extra, 2))

    def spend(self, seconds: float) -> None:
        self.extra += seconds

    def exhausted(self) -> bool:
        return self.remaining() <= 0


def work_queue(catalog: DataFrame, phase: str, limit: int, now: float, cfg: Config | None = None) -> DataFrame:
    """The next files of a phase: pending, live, cooled down, small ones first."""
    ext = sorted((cfg or Config()).phase_ext(phase))
    rows = catalog.where((F.col("status") == "pending") & C.live(F.col("deleted_at")) & F.col("ext").isin(ext) & C.cooled_down(now))
    return rows.orderBy(F.col("size_bytes").asc_nulls_first(), "id").limit(limit).select("id", "path", "ext", "size_bytes")


def caption_queue(catalog: DataFrame, contents: DataFrame, limit: int) -> DataFrame:
    """The next contents to caption, large files first: content_hash, path."""
    rows = caption_queue_rows(catalog, contents)
    return rows.orderBy(F.col("size_bytes").desc_nulls_last(), "id").limit(limit).select("content_hash", "path")


def finish(catalog: DataFrame, outcomes: DataFrame, now: float, cfg: Config | None = None) -> DataFrame:
    """The catalogue after a batch. ``outcomes``: id, outcome, new_hash, reason. outcome missing is a file that wasn't there:
    it is tried again until the retries are used up. A content hash once known stays; a good end resets the retries."""
    cfg = cfg or Config()
    o = outcomes.select(F.col("id").alias("o_id"), "outcome", "new_hash", "reason")
    j = catalog.join(o, F.col("id") == F.col("o_id"), "left")
    done, out, tries = F.col("o_id").isNotNull(), F.col("outcome"), F.coalesce("retry_count", F.lit(0))
    given_up = tries + 1 >= cfg.max_enrich_retries
    status = F.when(out == "missing", F.when(given_up, "failed").otherwise("pending")).otherwise(out)
    retries = F.when(out.isin("failed", "missing"), tries + 1).when(out.isin("done", "skipped", "unsupported"), 0).otherwise(tries)
    why = F.when(out == "missing", F.when(given_up, "file unreadable after repeated attempts").otherwise("file unreadable at enrichment time")).otherwise(F.nullif(C.clean_text(F.col("reason")), F.lit("")))
    new = {
        "status": F.when(done, status).otherwise(F.col("status")),
        "content_hash": F.coalesce(F.when(out != "missing", F.col("new_hash")), F.col("content_hash")),
        "retry_count": F.when(done, retries).otherwise(F.col("retry_count")).cast("int"),
        "error_reason": F.when(done, why).otherwise(F.col("error_reason")),
        "last_attempt": F.when(done, now).otherwise(F.col("last_attempt")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in catalog.columns])


def already_known(hashed: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose content is stored, one row for each content that isn't). Copies within the batch are one piece of work;
    its outcome goes to all of them, so a failing content fails for all its copies at once."""
    known = hashed.join(contents.select("content_hash"), "content_hash", "left_semi")
    fresh = hashed.join(contents.select("content_hash"), "content_hash", "left_anti")
    return known, fresh.groupBy("content_hash").agg(F.min(F.struct("id", "path", "ext", "size_bytes")).alias("f")).select("content_hash", "f.*")


def store(contents: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """Contents after an upsert of content_hash, extracted_text, source_kind, model: text, kind and length are replaced, model
    and time of the first storing stay. Texts are stored up to the cap, their length is the whole one."""
    n = new.select(F.col("content_hash").alias("h"), F.col("extracted_text").alias("t"), F.col("source_kind").alias("k"), F.col("model").alias("m"))
    j = contents.join(n, F.col("content_hash") == F.col("h"), "full")
    is_new = F.col("h").isNotNull()
    return j.select(
        F.coalesce("content_hash", "h").alias("content_hash"), F.when(is_new, F.substring("t", 1, C.TEXT_CAP)).otherwise(F.col("extracted_text")).alias("extracted_text"),
        F.when(is_new, F.col("k")).otherwise(F.col("source_kind")).alias("source_kind"), F.when(F.col("content_hash").isNull(), F.col("m")).otherwise(F.col("model")).alias("model"),
        F.when(is_new, F.char_length("t").cast("long")).otherwise(F.col("char_count")).alias("char_count"), F.when(F.col("content_hash").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
    )


def captioned(contents: DataFrame, captions: DataFrame) -> DataFrame:
    """Contents after captions (content_hash, caption, error): caption and old text, or only the kind, become 'image'."""
    c = captions.select("content_hash", F.when(F.col("error").isNull() & (F.trim("caption") != ""), F.col("caption")).alias("c"), F.lit(True).alias("tried"))
    j = contents.join(c, "content_hash", "left")
    text = F.when(F.col("c").isNotNull(), F.concat_ws("\n\n", "c", "extracted_text")).otherwise(F.col("extracted_text"))
    kind = F.when(F.col("tried") & (F.col("source_kind") == "image_meta"), "image").otherwise(F.col("source_kind"))
    new = {"extracted_text": text, "source_kind": kind, "char_count": F.when(F.col("c").isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("char_count"))}
    return j.select(*[new.get(x, F.col(x)).alias(x) for x in contents.columns])


def failure_streaks(outcomes: DataFrame, order: str = "seq", rows: int = 100_000) -> DataFrame:
    """``outcomes`` (order, ok, blames_model) with the running count of failures that blame the model: one that doesn't blame
    it leaves the count, a success resets it. The order (a whole number, null for none) is cut into ranges of ``rows``: counts run
    within a range, and what each hands on is found from one row a range, so no task sees the whole order."""
    blame = (~F.col("ok") & F.col("blames_model")).cast("int")
    o = outcomes.withColumn("_range", F.floor(F.col(order) / rows))
    run = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = o.withColumn("_island", F.sum(F.col("ok").cast("int")).over(run))
    island = Window.partitionBy("_range", "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = o.withColumn("streak", F.sum(blame).over(island))
    ends = o.groupBy("_range").agg(F.max("_island").alias("resets"), F.max_by("streak", order).alias("tail"))
    chain = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a range
    ends = ends.withColumn("_chain", F.sum((F.col("resets") > 0).cast("int")).over(chain))
    sums = Window.partitionBy("_chain").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = F.lag(F.sum("tail").over(sums)).over(Window.orderBy("_range"))
    ends = ends.select(F.col("_range").alias("_r"), F.coalesce(handed, F.lit(0)).alias("_handed"))
    out = o.join(ends, F.col("_range").eqNullSafe(F.col("_r")))
    streak = F.col("streak") + F.when(F.col("_island") == 0, F.col("_handed")).otherwise(0)
    return out.withColumn("streak", streak).drop("_range", "_island", "_r", "_handed")


def systemic(streaks: DataFrame, limit: int = STREAK_LIMIT) -> bool:
    return not streaks.where(F.col("streak") >= limit).isEmpty()


def blames_model(reason, phase: str):
    """Whether a failure is the model's: any in the caption phase, else by the reason's start."""
    if phase == "image_caption":
        return F.lit(True)
    out = F.lit(False)
    for start in MODEL_FAILURES:
        out = out | F.coalesce(reason.startswith(start), F.lit(False))
    return out


def split_budget(seconds: float, backlog: Sequence[tuple[str, int]], last_leading: int | None) -> dict[str, float]:
    """Seconds for each phase with work. The leading phase has all of it, unless its backlog hasn't shrunk since the last run:
    then it has three quarters and the later ones share the rest."""
    active = [(p, n) for p, n in backlog if n > 0]
    if not active:
        return {}
    lead, n = active[0]
    if last_leading is None or n < last_leading or len(active) == 1:
        return {lead: seconds}
    rest = seconds * 0.25 / (len(active) - 1)
    return {lead: seconds * 0.75} | {p: rest for p, _ in active[1:]}


def run_budget(meta: dict[str, str], today: str, cfg: Config, scheduled: bool) -> float:
    """Seconds a run may take: by hand the first-run budget each time; scheduled, what is left of the first pass in all,
    then what is left of the day."""
    if not scheduled:
        return float(cfg.first_run_budget_seconds)
    left = cfg.first_run_budget_seconds - float(meta.get("first_pass_spent_seconds", 0))
    if meta.get("first_pass_done") != "1" and left > 0:
        return left
    spent = float(meta.get("budget_spent_today", 0)) if meta.get("budget_day") == today else 0.0
    return max(0.0, cfg.daily_budget_seconds - spent)


def record_spend(meta: dict[str, str], today: str, cfg: Config, seconds: float, backlog_empty: bool) -> dict[str, str]:
    """The meta values after a scheduled run."""
    out = dict(meta)
    spent = float(meta.get("first_pass_spent_seconds", 0))
    if meta.get("first_pass_done") != "1" and spent < cfg.first_run_budget_seconds:
        out["first_pass_spent_seconds"] = str(spent + seconds)
        if backlog_empty or spent + seconds >= cfg.first_run_budget_seconds:
            out["first_pass_done"] = "1"
    else:
        day = float(meta.get("budget_spent_today", 0)) if meta.get("budget_day") == today else 0.0
        out |= {"first_pass_done": "1", "budget_day": today, "budget_spent_today": str(day + seconds)}
    return out
