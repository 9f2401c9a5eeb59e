"""A whole indexing run over a store: crawl, enrich in batches under a budget, prune."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.config import PHASES, STREAK_LIMIT, Config
from driftnet.embed import backend, embed_column
from driftnet.operators import crawl, enrich, maintenance, status
from driftnet.operators.store import Store
from driftnet.runtime import materialize
from driftnet.sources.extract import caption_files, hash_and_extract
from driftnet.sources.walk import walk_files


class ModelMismatch(Exception):
    """Stored vectors are of another model."""


class SystemicFailure(Exception):
    """The model fails on everything; what is left stays pending."""


def crawl_store(store: Store, cfg: Config, now: float, roots: list[str] | None = None, config: str | None = None) -> dict:
    """Walk the roots and publish the next catalogue; counts, and the roots that couldn't be read."""
    walked, good, bad = walk_files(store.spark, roots or cfg.folders, config)
    changes = materialize(crawl.diff(store.read("file_catalog"), walked, good, now, cfg), "crawl")
    counts = crawl.stats(changes).first().asDict()
    store.publish({"file_catalog": crawl.number_added(changes)})
    return counts | {"skipped_roots": bad}


def _dealt(files: DataFrame, key: str) -> DataFrame:
    """Files of a batch on all cores: a queue comes out of a limit in one partition."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, key)


def record_timings(store: Store, rows: DataFrame, now: float) -> None:
    """Append rows (source_kind, stage, seconds, bytes): one a file and stage. Numbers go on from the largest; rows are a batch's."""
    log = store.read("enrich_timing")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    number = F.row_number().over(Window.orderBy("source_kind", "stage", "seconds"))  # a batch of a few thousand files
    new = rows.where("seconds is not null").select((number + top).alias("id"), "source_kind", "stage", "seconds", "bytes", F.lit(now).alias("at"))
    store.publish({"enrich_timing": log.unionByName(new)})


def until_trip(outcomes: DataFrame, phase: str) -> tuple[DataFrame, bool]:
    """(the outcomes (seq, ok, reason, ...) up to where failures in a row blame the model, whether there is such a place)."""
    judged = outcomes.select("seq", "ok", enrich.blames_model(F.col("reason"), phase).alias("blames_model"))
    trip = enrich.failure_streaks(judged).where(F.col("streak") >= STREAK_LIMIT).agg(F.min("seq").alias("seq")).first()["seq"]
    return (outcomes, False) if trip is None else (outcomes.where(F.col("seq") <= trip), True)


def caption_batch(store: Store, cfg: Config, batch: int, now: float) -> dict[str, int]:
    """One batch of captions: each content once, whatever the outcome; texts with a caption are embedded again. Where the model
    fails ``STREAK_LIMIT`` times in a row only what came before stays tried, and the run ends."""
    catalog, contents, vectors = (store.read(n) for n in ("file_catalog", "file_embedding", "vec_embedding"))
    files = enrich.caption_queue(catalog, contents, batch).groupBy("content_hash").agg(F.min("path").alias("path"))
    got = materialize(caption_files(_dealt(files, "content_hash"), cfg), "captions")
    ok = F.col("error").isNull() & (F.col("caption") != "")
    numbered = got.select("*", F.row_number().over(Window.orderBy("content_hash")).alias("seq"), ok.alias("ok"), F.col("error").alias("reason"))  # of a batch
    got, trouble = until_trip(materialize(numbered, "captions"), "image_caption")
    counts = got.agg(F.count_if("ok").alias("done"), F.count(F.lit(1)).alias("n")).first()
    if not counts["n"]:
        return {}
    if trouble:
        # the failures of the streak are the model's: these contents stay in the queue
        last = got.where("ok").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        got = got.where(F.col("seq") <= last)
    after = enrich.captioned(contents, got.select("content_hash", "caption", "error"))
    told = got.where("ok").select("content_hash")
    again = after.join(told, "content_hash", "left_semi").select("content_hash", embed_column(cfg)("extracted_text").alias("e"))
    again = materialize(again, "captioned")
    new = again.where("e.error is null").select("content_hash", F.col("e.embedding").alias("embedding"))
    store.publish({"file_embedding": after, "vec_embedding": vectors.join(new.select("content_hash"), "content_hash", "left_anti").unionByName(new)})
    record_timings(store, got.select(F.lit("image").alias("source_kind"), F.lit("caption").alias("stage"), "seconds", F.lit(None).cast("long").alias("bytes")), now)
    if trouble:
        raise SystemicFailure("image_caption: every file fails alike")
    return {"done": counts["done"], "failed": counts["n"] - counts["done"]}


#: The log's name of the stage that reads a kind of file.
READING = {"document": "extract", "image": "image_meta", "image_meta": "image_meta", "audio": "transcribe", "video": "transcribe"}


def enrich_batch(store: Store, cfg: Config, phase: str, now: float, batch: int) -> dict[str, int]:
    """One batch of a phase: hash and extract, embed what isn't stored, publish all tables at once. Files by outcome.

    Files are read on all cores. Where failures in a row blame the model, the files behind stay pending and the run ends."""
    if phase == "image_caption":
        return caption_batch(store, cfg, batch, now)
    catalog, contents, vectors = (store.read(n) for n in ("file_catalog", "file_embedding", "vec_embedding"))
    files = enrich.work_queue(catalog, phase, batch, now, cfg)
    got = materialize(hash_and_extract(_dealt(files, "id"), cfg), "extracted")
    if got.isEmpty():
        return {}
    open_ = got.where("outcome is null")
    known, fresh = enrich.already_known(open_.join(files.select("id", "path", "ext", "size_bytes"), "id"), contents)
    text = open_.groupBy("content_hash").agg(F.min_by(F.struct("text", "source_kind"), "id").alias("t")).select("content_hash", "t.*")
    new = fresh.join(text, "content_hash").select("content_hash", F.col("text").alias("extracted_text"), "source_kind", embed_column(cfg)("text").alias("e"))
    new = materialize(new.withColumn("model", F.lit(backend(cfg).model_id)), "embedded")
    good = new.where("e.error is null")
    bad = new.where("e.error is not null").select("content_hash", F.col("e.error").alias("why"))
    ended = open_.join(bad, "content_hash", "left").select("id", F.when(F.col("why").isNull(), "done").otherwise("failed").alias("outcome"), F.col("content_hash").alias("new_hash"), F.col("why").alias("reason"))
    outcomes = got.where("outcome is not null").select("id", "outcome", F.col("content_hash").alias("new_hash"), "reason").unionByName(ended)
    outcomes = materialize(outcomes.select("*", F.col("id").alias("seq"), (F.col("outcome") != "failed").alias("ok")), "outcomes")
    outcomes, trouble = until_trip(outcomes, phase)
    vec = vectors.join(good.select("content_hash"), "content_hash", "left_anti").unionByName(good.select("content_hash", F.col("e.embedding").alias("embedding")))
    ends = outcomes.select("id", "outcome", "new_hash", "reason")
    store.publish({"file_catalog": enrich.finish(catalog, ends, now, cfg), "file_embedding": enrich.store(contents, good, now), "vec_embedding": vec})
    kind = F.coalesce("source_kind", F.lit({"document": "document", "audio": "audio"}.get(phase, "image")))
    stage = F.coalesce(F.create_map(*[F.lit(x) for pair in READING.items() for x in pair])[kind], F.lit("extract"))
    read = got.join(outcomes.select("id"), "id", "left_semi")
    times = read.select(kind.alias("source_kind"), F.lit("hash").alias("stage"), F.col("hash_seconds").alias("seconds"), "bytes")
    times = times.unionByName(read.select(kind.alias("source_kind"), stage.alias("stage"), F.col("read_seconds").alias("seconds"), "bytes"))
    times = times.unionByName(new.select("source_kind", F.lit("embed").alias("stage"), F.col("e.seconds").alias("seconds"), F.octet_length("extracted_text").cast("long").alias("bytes")))
    record_timings(store, times, now)
    if trouble:
        raise SystemicFailure(f"{phase}: every file fails alike")
    return {r["outcome"]: r["count"] for r in outcomes.groupBy("outcome").count().collect()}


def run(store: Store, cfg: Config, seconds: float, now: float, batch: int | None = None, limit: int = 0) -> dict:
    """Enrich phase by phase until nothing is pending or the budget or limit is used up. Batches grow with the cluster."""
    batch = batch or max(5_000, 250 * store.spark.sparkContext.defaultParallelism)
    model = backend(cfg)
    if not maintenance.model_matches(store.meta(), model.model_id, cfg.embed_dim, store.read("file_embedding")):
        raise ModelMismatch(f"the store holds vectors of {store.meta().get('embed_model')}; reindex before using {model.model_id}")
    store.publish({}, {"embed_model": model.model_id, "embed_dim": cfg.embed_dim})
    backlog = {r["phase"]: r["n"] for r in status.pending_by_phase(store.read("file_catalog"), store.read("file_embedding"), cfg).collect()}
    order = [(p, backlog.get(p, 0)) for p in PHASES]
    lead = next((p for p, n in order if n), None)
    last = store.meta().get(f"phase_pending_{lead}")
    done, counts, budget = 0, Counter(), enrich.Budget(seconds)
    shares = enrich.split_budget(seconds, order, int(last) if last else None)
    # the shares first, where a phase has stalled; then every phase to its end, in order, as far as the budget goes
    plan = [*(list(shares.items()) if len(shares) > 1 else []), *((p, seconds) for p in PHASES)]
    for phase, share in plan:
        own = enrich.Budget(share)
        while not budget.exhausted() and not own.exhausted():
            room = min(batch, limit - done) if limit else batch
            outcome = enrich_batch(store, cfg, phase, now, room) if room > 0 else {}
            counts.update(outcome)
            done += sum(outcome.values())
            if not outcome:
                break
    if lead:
        store.publish({}, {f"phase_pending_{lead}": dict(order)[lead]})
    model.release()
    store.vacuum()
    return {"processed": done, "counts": dict(counts), "seconds": seconds - budget.remaining()}


def prune_store(store: Store, now: float) -> None:
    names = ("file_catalog", "file_embedding", "vec_embedding", "enrich_timing")
    store.publish(maintenance.prune(*(store.read(n) for n in names), now))


def reindex_store(store: Store, cfg: Config) -> int:
    """Embed every stored text again; the model is stamped only if none failed. Texts that failed."""
    new, failed = maintenance.reindex(store.read("file_embedding"), store.read("vec_embedding"), embed_column(cfg))
    new = materialize(new, "reindexed")
    n = failed.first()["failed"]
    stamp = {} if n else {"embed_model": backend(cfg).model_id, "embed_dim": cfg.embed_dim}
    store.publish({"vec_embedding": new}, stamp)
    return n
