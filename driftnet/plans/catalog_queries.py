"""Queries over the file catalogue, by name, and the SQL each is checked against."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from driftnet.config import AUDIO_EXT, DOCUMENT_EXT, IMAGE_EXT, STATUSES, VIDEO_EXT, Config
from driftnet.functions import columns as C
from driftnet.functions import vectors as V
from driftnet.operators import crawl, enrich, geo, maintenance, search, status
from driftnet.runtime import forget, shared_dir, spread, table
from driftnet.sources.extract import hash_and_extract
from driftnet.sources.walk import walk_files

NOW = 1_800_000_000.0
TERM = "garden"
LIMIT = 20
FOLDERS = tuple(f"/srv/vol00/{x}" for x in ("Documents", "Downloads", "Pictures", "Scans", "Desktop"))
CITIES = ((-18.14, 178.44, "Suva, FJ"), (-13.83, -171.77, "Apia, WS"), (48.85, 2.35, "Paris, FR"), (-0.18, -78.47, "Quito, EC"), (43.7696, 11.2558, "Florence, IT"))


def _cat(s, d):
    return table(s, d, "file_catalog").withColumn("size_bytes", F.col("size_bytes").cast("long"))


def _emb(s, d):
    return table(s, d, "file_embedding")


def _vec(s, d):
    return table(s, d, "vec_embedding")


def _tim(s, d):
    return table(s, d, "enrich_timing")


def _query_vector(s, d):
    """The vector of the content whose hash comes first: one row."""
    v = _vec(s, d).where((F.size("embedding") == 128) & (V.norm(F.col("embedding")) > 0))
    return list(v.orderBy("content_hash").first()["embedding"])


def _walk(s, d):
    """A second look at the folders: live files but those that were skipped, files dated in the future one byte longer, failed
    tombstones back, and a new file beside each deleted one."""
    c = _cat(s, d)
    live = F.col("deleted_at").isNull()
    seen = c.where((live & (F.col("status") != "skipped")) | (~live & (F.col("status") == "failed")))
    seen = seen.select("path", F.when(F.col("mtime") > NOW, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "mtime")
    new = c.where(~live).select(F.concat("path", F.lit(".new.txt")).alias("path"), "size_bytes", "mtime")
    return seen.unionByName(new).withColumn("renamed", F.lit(0))


def _diff(s, d):
    return crawl.diff(_cat(s, d), _walk(s, d), ["/srv/vol00"], NOW)


def _outcomes(s, d):
    """An outcome for each live pending or failed row, from what is known of it."""
    rows = _cat(s, d).where("deleted_at is null and status in ('pending', 'failed')")
    out = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") < 2000, "skipped").when(F.col("ext") == "pdf", "failed").when(F.col("size_bytes") > 20000, "done").otherwise("missing")
    return rows.select("id", out.alias("outcome"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("new_hash"), F.when(out == "failed", "embed failed: x").alias("reason"))


def q01_content_hash(s, d):
    t = F.col("extracted_text")
    return _emb(s, d).where(t.isNotNull()).select("content_hash", C.content_hash(t).alias("text_hash"))


def q02_representatives(s, d):
    return search.representatives(_cat(s, d)).select("content_hash", "id", "path")


def q03_knn(s, d):
    near = search.nearest(_vec(s, d), _query_vector(s, d), LIMIT)
    return near.select("content_hash", F.round("squared", 6).alias("squared"), F.round(V.similarity(F.col("squared")), 6).alias("score"))


def q04_literal(s, d):
    return search.literal(_cat(s, d), TERM, LIMIT).select("path", "filename", "size", "score")


def q05_strip_markup(s, d):
    t = C.strip_markup(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


def q06_semantic(s, d):
    out = search.semantic(_cat(s, d), _emb(s, d), _vec(s, d), _query_vector(s, d), LIMIT)
    return out.orderBy("_order", "path").limit(LIMIT).select("path", "size", F.round("score", 6).alias("score"), "kind")


def q07_hybrid(s, d):
    q = _query_vector(s, d)
    out = search.search(_cat(s, d), _emb(s, d), _vec(s, d), TERM, "hybrid", LIMIT, embed=lambda texts: [q])
    return out.select("path", "filename", "size", F.round("score", 6).alias("score"), "kind")


def q08_overfetch(s, d):
    """What remains of the nearest min(8 * limit, 400) contents once only live files count."""
    near = search.nearest(_vec(s, d), _query_vector(s, d), min(8 * 60, 400))
    return near.join(search.representatives(_cat(s, d)), "content_hash").select("content_hash", "path")


def q09_status_counts(s, d):
    return status.status_counts(_cat(s, d))


def q10_folder_share(s, d):
    return status.folder_share(_cat(s, d), FOLDERS)


def q11_kind_counts(s, d):
    return status.kind_counts(_cat(s, d))


def q12_pending_by_phase(s, d):
    return status.pending_by_phase(_cat(s, d), _emb(s, d))


def q13_caption_backlog(s, d):
    return status.caption_queue_rows(_cat(s, d), _emb(s, d)).agg(F.count(F.lit(1)).alias("n"))


def q14_work_queue(s, d):
    return enrich.work_queue(_cat(s, d), "document", 50, NOW)


def q15_caption_queue(s, d):
    return enrich.caption_queue(_cat(s, d), _emb(s, d), 50)


def q16_seconds_per_file(s, d):
    return status.seconds_per_file(_tim(s, d), "document").select(F.round("seconds", 6).alias("seconds"))


def q17_backlog(s, d):
    return status.backlog_estimate(_cat(s, d), _emb(s, d), _tim(s, d), "document")


def _action(name):
    def query(s, d):
        return _diff(s, d).where(F.col("action") == name).select("path", "status", "retry_count", "content_hash", "first_seen", "last_seen", "deleted_at")

    query.__doc__ = f"Rows that the walk calls {name}."
    return query


def q22_crawl_stats(s, d):
    return crawl.stats(_diff(s, d))


def q23_purged(s, d):
    return maintenance.purge(_cat(s, d), NOW).select("id", "path")


def q24_orphans(s, d):
    return maintenance.orphans(_emb(s, d), maintenance.purge(_cat(s, d), NOW)).select("content_hash")


def q25_recent_timings(s, d):
    return maintenance.keep_recent(_tim(s, d), 1000).select("id", "source_kind", "stage", "seconds")


def q26_finish(s, d):
    return enrich.finish(_cat(s, d), _outcomes(s, d), NOW).select("id", "status", "content_hash", "retry_count", "error_reason", "last_attempt")


def q27_failure_streak(s, d):
    """Outcomes of the timing log in order: slow rows fail, those of embedding blame the model."""
    rows = _tim(s, d).groupBy("id").agg(F.max("seconds").alias("x"), F.max("stage").alias("stage"))
    judged = rows.select(F.col("id").alias("seq"), (F.coalesce("x", F.lit(9.0)) < 0.01).alias("ok"), (F.col("stage") == "embed").alias("blames_model"))
    return enrich.failure_streaks(judged).agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") >= 25).alias("tripped"))


def q28_snippet(s, d):
    return _emb(s, d).where("extracted_text is not null").select("content_hash", F.md5(C.one_line(F.regexp_replace("extracted_text", "[^ -~\\s]", "")) ).alias("line"))


def q29_normalize(s, d):
    v = V.normalized(F.col("embedding"))
    return _vec(s, d).where("embedding is not null").select("content_hash", F.size(v).alias("dim"), F.round(V.norm(v), 4).alias("norm"), F.round(v[0].cast("double"), 5).alias("first"))


def _points(s, d):
    return _cat(s, d).select("id", (F.pmod(F.col("id") * 37, F.lit(170)) - 85).cast("double").alias("lat"), (F.pmod(F.col("id") * 53, F.lit(360)) - 180).cast("double").alias("lon"))


def q30_nearest_place(s, d):
    cities = s.createDataFrame(list(CITIES), "lat double, lon double, name string")
    return geo.nearest_place(_points(s, d), cities).select("id", "place")


def q31_degrees(s, d):
    c = _cat(s, d)
    deg, mi, se = F.pmod("id", F.lit(90)), F.pmod("id", F.lit(60)), F.pmod(F.col("id") * 7, F.lit(60))
    ref = F.when(F.length("filename") > 14, "South").otherwise("N")
    return c.select("id", (F.round(C.dms_degrees(deg, mi, se, ref), 8) + 0.0).alias("degrees"))


def q32_image_description(s, d):
    c = _cat(s, d).where(F.col("ext").isin(sorted(IMAGE_EXT)))
    folder = F.element_at(F.split("path", "/"), -2)
    day = F.date_format(F.timestamp_seconds(F.col("mtime").cast("long")), "yyyy:MM:dd")
    text = C.image_description(folder, F.col("filename"), day, F.lit(None).cast("string"), F.col("error_reason"), F.col("size_bytes"), F.col("retry_count"), F.lit(""))
    return c.select("id", text.alias("text"))


def q33_extension(s, d):
    name = C.file_name(F.col("path"))
    return _cat(s, d).select("id", name.alias("name"), C.extension(name).alias("ext"))


def q34_embed_clip(s, d):
    t = F.substring("extracted_text", 1, C.EMBED_CLIP)
    return _emb(s, d).where("extracted_text is not null").select("content_hash", F.length(t).alias("n"), F.md5(t).alias("digest"))


def q35_work_saved(s, d):
    """The dedup probe against the stored documents: rows whose content is known, and one row of each content that isn't."""
    c = _cat(s, d).where("content_hash is not null").select("id", "path", "ext", "size_bytes", "content_hash")
    known, fresh = enrich.already_known(c, _emb(s, d).where("source_kind = 'document'"))
    return known.select("id", "content_hash", F.lit("known").alias("work")).unionByName(fresh.select("id", "content_hash", F.lit("fresh").alias("work")))


def q36_model_guard(s, d):
    """The guard's answers for the stamped model, another one, another length, no stamp, and an empty store."""
    e, stamp = _emb(s, d), {"embed_model": "one", "embed_dim": "128"}
    answers = [
        maintenance.model_matches(stamp, "one", 128, e), maintenance.model_matches(stamp, "two", 128, e), maintenance.model_matches(stamp, "one", 64, e),
        maintenance.model_matches({}, "two", 64, e), maintenance.model_matches(stamp, "two", 128, e.limit(0)),
    ]
    return s.createDataFrame([tuple(answers)], "same boolean, other boolean, other_dim boolean, unstamped boolean, empty boolean")


def q37_timing_by_stage(s, d):
    return status.timing_by_stage(_tim(s, d))


def q38_store_upsert(s, d):
    """Contents after texts of documents with the hash of an old one, or none, are stored."""
    first = table(s, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("h"), "text").groupBy("h").agg(F.min("text").alias("t"))
    new = first.select(F.col("h").alias("content_hash"), F.col("t").alias("extracted_text"), F.lit("document").alias("source_kind"), F.lit("new").alias("model"))
    old = _emb(s, d).select("content_hash", F.concat("extracted_text", F.lit("!")).alias("extracted_text"), F.lit("document").alias("source_kind"), F.lit("new").alias("model"))
    out = enrich.store(_emb(s, d), new.unionByName(old.where("source_kind is not null and extracted_text is not null")), NOW)
    return out.select("content_hash", F.md5("extracted_text").alias("digest"), "source_kind", "model", F.col("char_count").cast("long").alias("char_count"), "created_at")


def q39_human_units(s, d):
    c = _cat(s, d)
    return c.select("id", C.human_size(F.col("size_bytes")).alias("size"), C.human_duration(F.col("size_bytes") / 100.0).alias("duration"))


def q40_captioned(s, d):
    """Contents after half of those that wait for a caption got one and the others failed."""
    e = _emb(s, d)
    ok = F.length("extracted_text") > 200
    captions = e.where("source_kind = 'image_meta'").select("content_hash", F.when(ok, "a picture").otherwise("").alias("caption"), F.when(~ok, "no model").alias("error"))
    out = enrich.captioned(e, captions)
    return out.select("content_hash", "source_kind", F.md5("extracted_text").alias("digest"), F.col("char_count").cast("long").alias("char_count"))


def q41_crawl_snapshot(s, d):
    """The whole next catalogue: ids of new rows continue the old ones."""
    out = crawl.apply(_cat(s, d), _walk(s, d), ["/srv/vol00"], NOW)
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("top"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


def _tree(s, d) -> str:
    """Every text of documents as a file of a folder a source in the shared storage, written on the executors, beside files that a walk leaves out."""
    root = os.path.join(shared_dir(s).removeprefix("file://").removeprefix("file:"), "driftnet", f"tree-{uuid.uuid4().hex}")
    if "://" in root:
        raise ValueError("a walk needs a shared folder that is mounted")

    def write(batches):
        for pdf in batches:
            for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True):
                folder = os.path.join(root, re.sub(r"\W", "_", source or "none"))
                os.makedirs(os.path.join(folder, "node_modules"), exist_ok=True)
                for name in (f"{doc}.txt", f"._{doc}.txt", f"node_modules/{doc}.txt"):
                    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
                        f.write(text or "")
            yield pdf[["doc_id"]]

    spread(table(s, d, "documents").select("doc_id", "source", "text")).mapInPandas(write, "doc_id long").count()
    forget(s, "file://" + root)
    return root


def q42_walk_and_extract(s, d):
    """Files found by the walk source, hashed and extracted on the executors."""
    files, _, _ = walk_files(s, [_tree(s, d)])
    name = C.file_name(F.col("path"))
    rows = files.select(F.xxhash64("path").alias("id"), "path", C.extension(name).alias("ext"), "size_bytes")
    return hash_and_extract(rows, Config()).join(rows.select("id", "path"), "id").select(C.file_name(F.col("path")).alias("name"), F.md5("text").alias("digest"), "source_kind", F.coalesce("outcome", F.lit("open")).alias("outcome"))


def q43_reindex(s, d):
    """Every stored text embedded again by a model that fails on short texts, where the old vector stays."""
    n = F.char_length("extracted_text")
    model = lambda t: F.struct(F.when(F.char_length(t) > 400, F.array(F.char_length(t).cast("float"), F.lit(1.0).cast("float"))).alias("embedding"), F.when(F.coalesce(n, F.lit(0)) <= 400, "too short").alias("error"))
    new, failed = maintenance.reindex(_emb(s, d), _vec(s, d).groupBy("content_hash").agg(F.min("embedding").alias("embedding")), model)
    return new.select("content_hash", F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first")).crossJoin(F.broadcast(failed))  # one row is sent


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


_LIVE = "deleted_at is null"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REP = f"rep as (select content_hash, arg_min(id, (length(path), path)) id, arg_min(path, (length(path), path)) path, arg_min(filename, (length(path), path)) filename, arg_min(size_bytes, (length(path), path)) size_bytes from file_catalog where {_LIVE} and content_hash is not null group by content_hash)"
_USABLE = "usable as (select content_hash, list_transform(embedding, lambda x: (x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))::float) v from vec_embedding where len(embedding) = 128 and list_sum(list_transform(embedding, lambda y: y::double * y::double)) > 0)"
_ALL = "allv as (select content_hash, case when list_sum(list_transform(embedding, lambda y: y::double * y::double)) > 0 then list_transform(embedding, lambda x: (x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))::float) else embedding end v from vec_embedding where len(embedding) = 128)"
_NEAR = f"{_USABLE}, {_ALL}, q as (select v qv from usable order by content_hash limit 1), near as (select content_hash, power(list_distance(v::double[], qv::double[]), 2) d from allv, q order by d, content_hash limit {{k}})"
_KIND = f"case when lower(coalesce(ext, '')) in ({_list(DOCUMENT_EXT)}) then 'document' when lower(ext) in ({_list(IMAGE_EXT)}) then 'image' when lower(ext) in ({_list(AUDIO_EXT)}) then 'audio' when lower(ext) in ({_list(VIDEO_EXT)}) then 'video' else 'unsupported' end"
_LIT = f"lit as (select path, filename, coalesce(size_bytes, 0)::bigint size, case when contains(lower(filename), '{TERM}') then 0.9 else 0.6 end::double score, length(filename) o from file_catalog where {_LIVE} and ({_LOWER.format('filename')} like '%{TERM}%' or {_LOWER.format('path')} like '%{TERM}%') order by length(filename), path limit {LIMIT})"
_SEM = "sem as (select r.path, r.filename, coalesce(r.size_bytes, 0)::bigint size, greatest(0, 1 - near.d / 2) score, coalesce(e.source_kind, '') kind, near.d o from near join file_embedding e using (content_hash) join rep r using (content_hash))"
_WALK = f"""walk as (select path, case when mtime > {NOW} then size_bytes + 1 else size_bytes end::bigint size_bytes, mtime from file_catalog where (deleted_at is null and status <> 'skipped') or (deleted_at is not null and status = 'failed')
 union all select path || '.new.txt', size_bytes::bigint, mtime from file_catalog where deleted_at is not null)"""
_DIFF = f"""{_WALK}, j as (select c.*, w.path w_path, w.size_bytes w_size, w.mtime w_mtime, case when c.path is null then 'added' when w.path is null and not starts_with(c.path, '/srv/vol00/') then 'outside'
 when w.path is null and c.deleted_at is not null then 'gone' when w.path is null then 'tombstoned' when c.size_bytes is distinct from w.size_bytes or c.mtime is distinct from w.mtime then 'changed'
 when c.status = 'failed' and c.retry_count < 3 then 'requeued' else 'seen' end action from file_catalog c full join walk w on c.path = w.path)"""
_ACTION = f"""with {_DIFF} select coalesce(path, w_path) path, case when action = 'added' then 'pending' when action = 'changed' then case when {_KIND} = 'unsupported' then 'unsupported' else 'pending' end when action = 'requeued' then 'pending' else status end status,
 case when action in ('added', 'changed') then 0 else retry_count end::int retry_count, case when action not in ('added', 'changed') then content_hash end content_hash, case when action = 'added' then {NOW} else first_seen end first_seen,
 case when action in ('added', 'changed', 'requeued', 'seen') then {NOW} else last_seen end last_seen, case when action = 'tombstoned' then {NOW} when action in ('added', 'changed', 'requeued', 'seen') then null else deleted_at end deleted_at from j where action = '{{a}}'"""
_SIZE = "case when size_bytes is null or size_bytes = 0 then '?' " + " ".join(f"when size_bytes < {1024 ** (i + 1)} then round_even(size_bytes / {1024.0**i}, 0)::bigint::varchar || '{u}'" for i, u in enumerate("BKMGT")) + " else 'P' end"
_PENDING = f"select 'document' phase, 0 place, count(*) filter (ext in ({_list(DOCUMENT_EXT)})) n from file_catalog where {_LIVE} and status = 'pending'"
_WAITING = f"select count(*) n from file_catalog c join file_embedding e using (content_hash) where c.{_LIVE} and e.source_kind = 'image_meta'"
_RATE = "rate as (select sum(seconds) / count(*) filter (stage = 'hash') s from (select seconds, stage from enrich_timing where source_kind = 'document' order by id desc, stage, seconds limit 2000))"

ORACLE = {
    "q01_content_hash": "select content_hash, sha256(concat(strlen(extracted_text)::varchar, extracted_text)) text_hash from file_embedding where extracted_text is not null",
    "q02_representatives": f"with {_REP} select content_hash, id, path from rep",
    "q03_knn": f"with {_NEAR.format(k=LIMIT)} select content_hash, round(d, 6) squared, round(greatest(0, 1 - d / 2), 6) score from near",
    "q04_literal": f"with {_LIT} select path, filename, size, score from lit",
    "q05_strip_markup": "select doc_id, md5(t) digest, length(t) n from (select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\s\\x0b\\x85\\x{00A0}\\p{Z}]+', ' ', 'g')) t from documents)",
    "q06_semantic": f"with {_REP}, {_NEAR.format(k=min(8 * LIMIT, 400))}, {_SEM} select path, size, round(score, 6) score, kind from sem order by o, path limit {LIMIT}",
    "q07_hybrid": f"with {_REP}, {_NEAR.format(k=min(8 * LIMIT, 400))}, {_SEM}, {_LIT} select coalesce(a.path, b.path) path, coalesce(a.filename, b.filename) filename, coalesce(a.size, b.size) size, round(case when a.path is not null and b.path is not null then least(greatest(a.score, b.score) + 0.15, 1.0) else coalesce(a.score, b.score) end, 6) score, coalesce(b.kind, '') kind from lit a full join sem b on a.path = b.path order by case when a.path is not null and b.path is not null then least(greatest(a.score, b.score) + 0.15, 1.0) else coalesce(a.score, b.score) end desc, (a.path is null)::int, coalesce(a.o, b.o), coalesce(a.path, b.path) limit {LIMIT}",
    "q08_overfetch": f"with {_REP}, {_NEAR.format(k=400)} select content_hash, rep.path from near join rep using (content_hash)",
    "q09_status_counts": f"select s.status, count(c.id) n from (values {', '.join(f"('{x}')" for x in STATUSES)}) s(status) left join file_catalog c on c.status = s.status and c.{_LIVE} group by s.status",
    "q10_folder_share": f"with live as (select path from file_catalog where {_LIVE}) select f.folder, count(*) n, round(100.0 * count(*) / (select count(*) from live), 6)::double share, 100.0 * count(*) / (select count(*) from live) >= 50 dominant from (values {', '.join(f"('{x}')" for x in FOLDERS)}) f(folder) join live on starts_with(path, f.folder || '/') group by f.folder",
    "q11_kind_counts": f"select {_KIND} kind, count(*) n from file_catalog where {_LIVE} group by 1",
    "q12_pending_by_phase": f"{_PENDING} union all select 'image_meta', 1, count(*) filter (ext in ({_list(IMAGE_EXT)})) from file_catalog where {_LIVE} and status = 'pending' union all select 'audio', 2, count(*) filter (ext in ({_list(AUDIO_EXT | VIDEO_EXT)})) from file_catalog where {_LIVE} and status = 'pending' union all select 'image_caption', 3, n from ({_WAITING})",
    "q13_caption_backlog": _WAITING,
    "q14_work_queue": f"select id, path, ext, size_bytes::bigint size_bytes from file_catalog where status = 'pending' and {_LIVE} and ext in ({_list(DOCUMENT_EXT)}) and (retry_count = 0 or last_attempt is null or last_attempt < {NOW} - 60) order by size_bytes asc nulls first, id limit 50",
    "q15_caption_queue": f"select content_hash, path from file_catalog c join file_embedding e using (content_hash) where c.{_LIVE} and e.source_kind = 'image_meta' order by size_bytes desc nulls last, id limit 50",
    "q16_seconds_per_file": f"with {_RATE} select round(s, 6) as \"seconds\" from rate",
    "q17_backlog": f"with {_RATE}, n as ({_PENDING}) select phase, n, round(n * s, 4) work_seconds, round(n * s / 1200, 6) as \"days\" from n, rate",
    **{f"q{18 + i}_crawl_{a}": _ACTION.format(a=a) for i, a in enumerate(("added", "changed", "requeued", "tombstoned"))},
    "q22_crawl_stats": f"with {_DIFF} select count(*) filter (action in ('added', 'changed', 'requeued', 'seen')) seen, count(*) filter (action = 'added') added, count(*) filter (action in ('changed', 'requeued', 'seen')) updated, count(*) filter (action = 'tombstoned') tombstoned from j",
    "q23_purged": f"select id, path from file_catalog where deleted_at is null or deleted_at >= {NOW} - 90 * 86400",
    "q24_orphans": f"select content_hash from file_embedding e where not exists (select 1 from file_catalog c where c.content_hash = e.content_hash and (c.deleted_at is null or c.deleted_at >= {NOW} - 90 * 86400))",
    "q25_recent_timings": "select id, source_kind, stage, \"seconds\" from enrich_timing where id >= (select max(id) - 1000 from enrich_timing)",
    "q26_finish": f"""with o as (select id o_id, case when size_bytes is null then 'missing' when size_bytes < 2000 then 'skipped' when ext = 'pdf' then 'failed' when size_bytes > 20000 then 'done' else 'missing' end outcome from file_catalog where {_LIVE} and status in ('pending', 'failed'))
 select id, case when o_id is null then status when outcome = 'missing' then case when retry_count + 1 >= 3 then 'failed' else 'pending' end else outcome end status, case when outcome <> 'missing' then 'h' || id else content_hash end content_hash,
 case when o_id is null then retry_count when outcome in ('failed', 'missing') then retry_count + 1 else 0 end::int retry_count, case when o_id is null then error_reason when outcome = 'missing' then case when retry_count + 1 >= 3 then 'file unreadable after repeated attempts' else 'file unreadable at enrichment time' end when outcome = 'failed' then 'embed failed: x' end error_reason,
 case when o_id is null then last_attempt else {NOW} end last_attempt from file_catalog left join o on id = o_id""",
    "q27_failure_streak": "with r as (select id, coalesce(max(\"seconds\"), 9) < 0.01 ok, max(stage) = 'embed' m from enrich_timing group by id), i as (select *, sum(ok::int) over (order by id) g from r), s as (select sum((not ok and coalesce(m, false))::int) over (partition by g order by id) k from i) select max(k)::bigint longest, count(*) filter (k >= 25) tripped from s",
    "q28_snippet": "select content_hash, md5(substr(trim(regexp_replace(regexp_replace(extracted_text, '[^ -~\\s]', '', 'g'), '\\s+', ' ', 'g')), 1, 150)) line from file_embedding where extracted_text is not null",
    "q29_normalize": "with n as (select content_hash, embedding e, sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) n from vec_embedding where embedding is not null), u as (select content_hash, list_transform(e, lambda x: case when n > 0 then (x::double / n)::float::double else x::double end) u from n) select content_hash, len(u)::int dim, round(sqrt(list_sum(list_transform(u, lambda y: y * y))), 4) norm, round(u[1], 5) \"first\" from u",
    "q30_nearest_place": f"with p as (select id, ((id * 37) % 170 - 85)::double lat, ((id * 53) % 360 - 180)::double lon from file_catalog), c(clat, clon, name) as (values {', '.join(str(x) for x in CITIES)}) select id, arg_min(name, power((((clon - lon + 180) % 360 + 360) % 360 - 180) * cos(radians(lat)), 2) + power(clat - lat, 2)) place from p, c group by id",
    "q31_degrees": "select id, round((id % 90 + (id % 60) / 60.0::double + (id * 7 % 60) / 3600.0::double) * case when length(filename) > 14 then -1 else 1 end, 8) + 0.0::double degrees from file_catalog",
    "q32_image_description": f"select id, concat_ws(chr(10), 'file: ' || split_part(path, '/', -2) || '/' || filename, 'taken: ' || strftime(to_timestamp(mtime::bigint - case when mtime::bigint > mtime then 1 else 0 end) at time zone 'UTC', '%Y:%m:%d'), 'camera: ' || nullif(error_reason, ''), case when coalesce(size_bytes, 0) > 0 then 'size: ' || size_bytes::bigint || 'x' || retry_count end) text from file_catalog where ext in ({_list(IMAGE_EXT)})",
    "q33_extension": "select id, split_part(path, '/', -1) name, lower(regexp_extract(split_part(path, '/', -1), '^\\.*[^.].*\\.([^.]*)$', 1)) ext from file_catalog",
    "q34_embed_clip": "select content_hash, length(substr(extracted_text, 1, 8000))::int n, md5(substr(extracted_text, 1, 8000)) digest from file_embedding where extracted_text is not null",
    "q35_work_saved": "with k as (select content_hash from file_embedding where source_kind = 'document') select id, content_hash, 'known' as work from file_catalog where content_hash in (select * from k) union all select min(id), content_hash, 'fresh' from file_catalog where content_hash is not null and content_hash not in (select * from k) group by content_hash",
    "q36_model_guard": "select true same, count(*) = 0 other, count(*) = 0 other_dim, true unstamped, true as \"empty\" from file_embedding",
    "q37_timing_by_stage": "select source_kind, stage, count(*) n, round(sum(\"seconds\"), 3) as \"seconds\", max(\"seconds\") slowest from enrich_timing group by 1, 2",
    "q38_store_upsert": f"with n as (select sha256(text) h, min(text) t from documents group by 1 union all select content_hash, extracted_text || '!' from file_embedding where extracted_text is not null) select coalesce(content_hash, h) content_hash, md5(case when h is not null then t else extracted_text end) digest, case when h is not null then 'document' else source_kind end source_kind, case when content_hash is null then 'new' else model end model, case when h is not null then length(t) else char_count end::bigint char_count, case when content_hash is null then {NOW} else created_at end created_at from file_embedding e full join n on e.content_hash = n.h",
    "q39_human_units": f"select id, {_SIZE} size, case when size_bytes / 100.0 < 90 then round_even(size_bytes / 100.0::double, 0)::bigint || 's' when size_bytes / 100.0 < 5400 then round_even(size_bytes / 100.0::double / 60, 0)::bigint || ' min' when size_bytes is not null then format('{{:.1f}}', size_bytes / 100.0::double / 3600) || ' h' end duration from file_catalog",
    "q40_captioned": "select content_hash, case when source_kind = 'image_meta' then 'image' else source_kind end source_kind, md5(case when source_kind = 'image_meta' and length(extracted_text) > 200 then 'a picture' || chr(10) || chr(10) || extracted_text else extracted_text end) digest, case when source_kind = 'image_meta' and length(extracted_text) > 200 then length(extracted_text) + 11 else char_count end::bigint char_count from file_embedding",
    "q41_crawl_snapshot": f"with {_DIFF} select count(*) n, count(*) ids, (select max(id) from file_catalog) + count(*) filter (action = 'added') top, count(*) filter (case when action = 'tombstoned' then true when action in ('added', 'changed', 'requeued', 'seen') then false else deleted_at is not null end) deleted, sum(coalesce(case when action in ('added', 'changed') then w_size else size_bytes end, 0))::bigint \"bytes\" from j",
    "q42_walk_and_extract": "select doc_id || '.txt' as name, case when regexp_matches(text, '\\S') then md5(text) end digest, 'document' source_kind, case when regexp_matches(text, '\\S') then 'open' else 'failed' end outcome from documents where octet_length(encode(text)) >= 16",
    "q43_reindex": "with v as (select content_hash, min(embedding) v from vec_embedding group by 1), e as (select f.content_hash, case when length(extracted_text) > 400 then [length(extracted_text)::float, 1.0::float] else v end e from file_embedding f left join v on v.content_hash = f.content_hash) select content_hash, len(e)::int dim, round(e[1]::double, 5) as \"first\", (select count(*) from file_embedding where coalesce(length(extracted_text), 0) <= 400) failed from e where e is not null",
}

QUERIES = {
    "q07_hybrid": q07_hybrid, "q01_content_hash": q01_content_hash, "q02_representatives": q02_representatives, "q03_knn": q03_knn, "q04_literal": q04_literal,
    "q05_strip_markup": q05_strip_markup, "q06_semantic": q06_semantic, "q08_overfetch": q08_overfetch, "q09_status_counts": q09_status_counts, "q10_folder_share": q10_folder_share,
    "q11_kind_counts": q11_kind_counts, "q12_pending_by_phase": q12_pending_by_phase, "q13_caption_backlog": q13_caption_backlog, "q14_work_queue": q14_work_queue,
    "q15_caption_queue": q15_caption_queue, "q16_seconds_per_file": q16_seconds_per_file, "q17_backlog": q17_backlog,
    **{f"q{18 + i}_crawl_{a}": _action(a) for i, a in enumerate(("added", "changed", "requeued", "tombstoned"))},
    "q22_crawl_stats": q22_crawl_stats, "q23_purged": q23_purged, "q24_orphans": q24_orphans, "q25_recent_timings": q25_recent_timings, "q26_finish": q26_finish,
    "q27_failure_streak": q27_failure_streak, "q28_snippet": q28_snippet, "q29_normalize": q29_normalize, "q30_nearest_place": q30_nearest_place, "q31_degrees": q31_degrees,
    "q32_image_description": q32_image_description, "q33_extension": q33_extension, "q34_embed_clip": q34_embed_clip, "q35_work_saved": q35_work_saved, "q36_model_guard": q36_model_guard,
    "q37_timing_by_stage": q37_timing_by_stage, "q38_store_upsert": q38_store_upsert, "q39_human_units": q39_human_units, "q40_captioned": q40_captioned, "q41_crawl_snapshot": q41_crawl_snapshot,
    "q42_walk_and_extract": q42_walk_and_extract, "q43_reindex": q43_reindex,
}
