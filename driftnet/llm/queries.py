"""Queries of the training-data operators over a data directory, and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftnet.llm import emails, mixing, mojibake, near_duplicates, neighbours, packing, percentiles, residue, scans, splitting, tokens
from driftnet.runtime import day_of, forget, materialize, shared_dir, table


def p1_found(spark, sf_dir):
    """Pairs of contents whose texts share at least 0.6 of their runs of three words."""
    pairs = near_duplicates.similar_pairs(table(spark, sf_dir, "file_embedding"), "content_hash", "extracted_text")
    return pairs.select("content_hash_a", "content_hash_b")


def p1_groups(spark, sf_dir):
    """The class of every content that has a near duplicate, its links, and the catalog paths that carry it."""
    pairs, members = near_duplicates.similar_sets(table(spark, sf_dir, "file_embedding"), "content_hash", "extracted_text")
    found = near_duplicates.classes(pairs, members)
    sizes = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    paths = table(spark, sf_dir, "file_catalog").where("content_hash is not null").select(F.col("content_hash").alias("id"), "path")
    return found.join(sizes, "class_id").join(paths, "id", "left").select(F.col("id").alias("content_hash"), "class_id", "class_size", "links", "path")


def _mail_lines(spark, sf_dir):
    mails = materialize(emails.mail_contents(table(spark, sf_dir, "file_embedding"), table(spark, sf_dir, "file_catalog")), "mails")
    return emails.marked_lines(mails)


def p2_found(spark, sf_dir):
    """The lines of e-mails that their sender newly wrote."""
    return _mail_lines(spark, sf_dir).where("mark = 'N'").select(F.col("id").alias("content_hash"), "line_no")


def p2_reduced(spark, sf_dir):
    """Each e-mail reduced to what its sender newly wrote, paragraphs kept."""
    lines = _mail_lines(spark, sf_dir).where("mark in ('N', 'B')").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    text = F.concat_ws("\n", F.transform("l", lambda x: F.regexp_replace(x["line"], "\\s+$", "")))
    return lines.select(F.col("id").alias("content_hash"), F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "").alias("new_text"))


def p3_found(spark, sf_dir):
    """Pairs in which either content is among the 5 most similar of the other."""
    return neighbours.linked_pairs(table(spark, sf_dir, "vec_embedding"), "content_hash", "embedding")


def p3_neighbours(spark, sf_dir):
    """The 5 most similar contents of every usable vector, with cosine and rank."""
    return neighbours.nearest(table(spark, sf_dir, "vec_embedding"), "content_hash", "embedding")


def p10_judged(spark, sf_dir):
    """Coverage by residue and unfilled placeholders of every text of documents."""
    return residue.judged(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p10_found(spark, sf_dir):
    """Texts that are template residue, filler, an error message or a script notice."""
    return p10_judged(spark, sf_dir).where("residue").select("doc_id").distinct()


def p10_kept(spark, sf_dir):
    """The documents that remain once residue is left out."""
    d = table(spark, sf_dir, "documents")
    return d.join(p10_found(spark, sf_dir), "doc_id", "left_anti")


def _timings(spark, sf_dir):
    t = table(spark, sf_dir, "enrich_timing")
    return percentiles.once_per_id(t, "id", ["source_kind", "stage", "seconds", "at"]).withColumn("day", day_of(F.col("at")))


def p7_percentiles(spark, sf_dir):
    """Exact median, 90th and 99th percentile of seconds for each source kind, stage and day."""
    out = percentiles.percentiles(_timings(spark, sf_dir), ["source_kind", "stage", "day"], "seconds")
    return out.withColumn("error", F.lit(0.0))


def p7_stage_percentiles(spark, sf_dir):
    """Exact percentiles of seconds for each source kind and stage over all days."""
    return percentiles.percentiles(_timings(spark, sf_dir), ["source_kind", "stage"], "seconds")


def p7_merged_days(spark, sf_dir):
    """Bounds on the percentiles of each source kind and stage, from histograms made a day at a time and added up."""
    daily = percentiles.leading_histogram(_timings(spark, sf_dir), ["source_kind", "stage", "day"], "seconds")
    return percentiles.merged_percentiles(daily, ["source_kind", "stage"])


def p4_restored(spark, sf_dir):
    """Garbled values of contents and of the catalog, with the original as far as it can be restored."""
    texts = mojibake.garbled(table(spark, sf_dir, "file_embedding"), "content_hash", {"extracted_text": "text"})
    names = mojibake.garbled(table(spark, sf_dir, "file_catalog"), "id", {"filename": "text", "path": "path"})
    return texts.unionByName(names)


def p4_found(spark, sf_dir):
    """Which values were decoded with a wrong encoding, restorable or not."""
    return p4_restored(spark, sf_dir).select("field_name", "record_key")


def _limits(spark, sf_dir):
    """size_limits, a parameter table of a few rows."""
    return {r["limit_name"]: r for r in table(spark, sf_dir, "size_limits").collect()}


def p5_found(spark, sf_dir):
    """Contents that were split, because their text exceeds the embed_clip limit."""
    lim = _limits(spark, sf_dir)["embed_clip"]
    e = table(spark, sf_dir, "file_embedding")
    return splitting.oversized(e, "content_hash", "extracted_text", lim["max_size"], lim["overlap"]).select(F.col("id").alias("content_hash"))


def p5_pieces(spark, sf_dir):
    """The pieces of every content whose text exceeds the embed_clip limit."""
    lim = _limits(spark, sf_dir)["embed_clip"]
    return splitting.split_texts(table(spark, sf_dir, "file_embedding"), "content_hash", "extracted_text", lim["max_size"], lim["overlap"])


def p5_rebuilt(spark, sf_dir):
    """The hash of every split content's text as put together from its pieces, and whether all pieces are within the limit."""
    lim = _limits(spark, sf_dir)["embed_clip"]
    own = F.when(F.col("piece") > 0, F.substring("text", lim["overlap"] + 1, lim["max_size"])).otherwise(F.col("text"))
    rows = p5_pieces(spark, sf_dir).select("id", "piece", "chars", own.alias("own"))
    one = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "own"))).alias("p"), F.max("chars").alias("longest"))  # the pieces of one text
    text = F.concat_ws("", F.transform("p", lambda x: x["own"]))
    return one.select(F.col("id").alias("content_hash"), F.sha2(text, 256).alias("text_hash"), (F.col("longest") <= lim["max_size"]).alias("within"))


def p5_files(spark, sf_dir, range_bytes: int = 1 << 18):
    """Files of all texts, written to the shared folder and split by byte ranges: the characters that the pieces cover, and
    how many pieces are over the limit."""
    lim = _limits(spark, sf_dir)["embed_clip"]
    folder = f"{shared_dir(spark)}/driftnet/files-{uuid.uuid4().hex}"
    texts = table(spark, sf_dir, "file_embedding").where("extracted_text is not null").select("extracted_text")
    texts.write.option("lineSep", "\n\n").text(folder)
    forget(spark, folder)
    paths = [r[0] for r in spark.read.text(folder).select(F.input_file_name()).distinct().collect()]
    pieces = splitting.split_files(spark, paths, lim["max_size"], lim["overlap"], range_bytes)
    covered = F.sum(F.when(F.col("piece") > 0, F.col("chars") - lim["overlap"]).otherwise(F.col("chars")))
    return pieces.agg(covered.alias("characters"), F.count_if(F.col("chars") > lim["max_size"]).alias("over_limit"))


def _scans(spark, sf_dir):
    return scans.label_lines(table(spark, sf_dir, "file_embedding"), "content_hash", "extracted_text")


def p6_found(spark, sf_dir):
    """The faulty lines of scanned pages, by kind of fault."""
    lines, words = _scans(spark, sf_dir)
    return scans.faults(lines, words).select(F.col("id").alias("content_hash"), "line_no", "fault")


def p6_paragraphs(spark, sf_dir):
    """Scanned contents as continuous paragraphs, repaired."""
    return scans.paragraphs(*_scans(spark, sf_dir)).withColumnRenamed("id", "content_hash")


def p8_containers(spark, sf_dir):
    """Every text of documents in a container of each of the three pack sizes."""
    caps = {n: r["max_size"] for n, r in _limits(spark, sf_dir).items() if n.startswith("pack_") and r["unit"] == "tokens"}
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", tokens.token_count(F.col("text")), caps)


def p8_fill(spark, sf_dir):
    """How full the containers of each size are."""
    lim = table(spark, sf_dir, "size_limits").select("limit_name", "max_size")
    return (
        p8_containers(spark, sf_dir).groupBy("limit_name")
        .agg(F.count(F.lit(1)).alias("items"), F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"))
        .join(lim, "limit_name")
        .select("limit_name", "items", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("max_size"))).alias("fill"))
    )


def p8_checked(spark, sf_dir):
    """Of each pack size: containers over the capacity, texts that were cut though they fit, texts whose pieces leave a gap, texts
    that come in no row, and rows without a container (texts without tokens)."""
    lim = table(spark, sf_dir, "size_limits").select("limit_name", "max_size")
    rows = materialize(p8_containers(spark, sf_dir), "packed").join(F.broadcast(lim), "limit_name")  # a row a limit
    over = rows.where("container_id is not null").groupBy("limit_name", "container_id").agg((F.sum("size") > F.first("max_size")).alias("over"))
    over = over.groupBy("limit_name").agg(F.count_if("over").alias("over_capacity"))
    texts = rows.groupBy("limit_name", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"), F.first("max_size").alias("max_size"))
    texts = texts.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("max_size"))).alias("cut_needlessly"), F.count_if(F.col("size") != F.col("end")).alias("with_gaps")
    )
    empty = rows.groupBy("limit_name").agg(F.count_if(F.col("container_id").isNull()).alias("without_container"))
    return texts.join(over, "limit_name").join(empty, "limit_name")


def _mix(spark, sf_dir):
    targets = table(spark, sf_dir, "mix_targets")
    texts = mixing.sized_texts(table(spark, sf_dir, "documents"), targets, "doc_id", "source", "text", tokens.token_count(F.col("text")))
    return mixing.mix(texts, targets), texts, targets


def p9_selection(spark, sf_dir):
    """The texts of the mixture, with how often each is used."""
    out, _, _ = _mix(spark, sf_dir)
    return out.select(F.col("key").alias("doc_id"), "source", F.col("size").alias("tokens"), "copies")


def p9_shares(spark, sf_dir):
    """The share of all tokens that each source reaches in the mixture."""
    return mixing.reached_shares(*_mix(spark, sf_dir))


def p9_checked(spark, sf_dir):
    """Of each target with texts, and of any other source that the selection names: uses above the cap, rows that repeat a text,
    and texts of another source or of none. A target of whose texts none was selected has a row too."""
    out, _, targets = _mix(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    docs = d.where("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("source").alias("own"), F.sha2("text", 256).alias("h"))
    docs = docs.repartition("key").distinct()  # a row delivered twice is one row; the join by key uses the same shuffle
    caps = F.broadcast(targets.where("target_share > 0 and max_repeats > 0").select("source", "max_repeats"))  # a row a target
    # outer joins: a row of the selection without a document or a target is a fault, not a row to drop
    j = out.join(docs, "key", "left").join(caps, "source", "left").withColumn("h", F.coalesce("h", F.col("key").cast("string")))
    cap, misplaced = F.coalesce(F.first("max_repeats"), F.lit(0)), F.count_if(~F.col("own").eqNullSafe(F.col("source")))
    texts = j.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("uses"), cap.alias("cap"), misplaced.alias("misplaced"))
    everywhere = Window.partitionBy("h")  # a text that two sources hold is one text
    texts = texts.withColumn("n", F.sum("n").over(everywhere)).withColumn("uses", F.sum("uses").over(everywhere))
    found = texts.groupBy("source").agg(F.count_if(F.col("uses") > F.col("cap")).alias("over_cap"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("misplaced").alias("misplaced"))
    named = d.where("text <> ''").select("source").distinct().join(caps, "source").select("source")
    return named.join(found, "source", "full").na.fill(0, ["over_cap", "repeated", "misplaced"])


def p7_bounds(spark, sf_dir):
    """The exact percentiles of each source kind and stage, and whether the bounds merged from days hold them."""
    exact = p7_stage_percentiles(spark, sf_dir)
    merged = p7_merged_days(spark, sf_dir).select(F.col("source_kind").alias("k"), F.col("stage").alias("s"), F.col("p").alias("q"), "low", "high")
    j = exact.join(merged, exact["source_kind"].eqNullSafe(F.col("k")) & exact["stage"].eqNullSafe(F.col("s")) & (exact["p"] == F.col("q")))
    close = F.col("high") - F.col("low") <= F.abs(F.col("seconds")) * 2.0**-15 + 1e-300
    return j.select("source_kind", "stage", "p", "n", "seconds", F.col("seconds").between(F.col("low"), F.col("high")).alias("held"), close.alias("close"))


_TIMINGS = """
with t as (select id, min(source_kind) as source_kind, min(stage) as stage, min("seconds") as "seconds", min("at") as at_ from enrich_timing group by id),
r as (select source_kind, stage, {day} "seconds", row_number() over (partition by source_kind, stage{part} order by "seconds") rn,
 count(*) over (partition by source_kind, stage{part}) n from t where "seconds" is not null)
select r.source_kind, r.stage, {out} p.p, r.n, r."seconds"{error} from r join (values (0.5::double), (0.9::double), (0.99::double)) p(p)
 on r.rn = greatest(1, ceil(p.p * r.n - 1e-9))
"""
_DAY = "date '1970-01-01' + cast(floor(at_ / 86400) as integer)"

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_reduced": p2_reduced,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rebuilt": p5_rebuilt,
    "p5_files": p5_files,
    "p6_found": p6_found,
    "p6_paragraphs": p6_paragraphs,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_checked": p8_checked,
    "p9_checked": p9_checked,
    "p7_bounds": p7_bounds,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_judged": p10_judged,
    "p10_kept": p10_kept,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p7_percentiles": p7_percentiles,
    "p7_stage_percentiles": p7_stage_percentiles,
    "p7_merged_days": p7_merged_days,
}
_RUNS = r"""
with w as (select content_hash, regexp_extract_all(lower(extracted_text), '[\p{L}\p{N}]+') as w from file_embedding where extracted_text is not null and content_hash is not null),
s as (select distinct content_hash, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) as run from w where len(w) >= 40),
n as (select content_hash, count(*) as n from s group by content_hash),
b as (select x.content_hash as a, y.content_hash as b, count(*) as both_ from s x join s y on x.run = y.run and x.content_hash < y.content_hash group by all)
select a as content_hash_a, b as content_hash_b from b join n na on na.content_hash = a join n nb on nb.content_hash = b where both_ >= 0.6 * (na.n + nb.n - both_)
"""

ORACLE = {
    "p1_found": _RUNS,
    "p5_found": "select content_hash from file_embedding where length(extracted_text) > (select max_size from size_limits where limit_name = 'embed_clip')",
    "p5_rebuilt": "select content_hash, sha256(extracted_text) as text_hash, true as within from file_embedding where length(extracted_text) > (select max_size from size_limits where limit_name = 'embed_clip')",
    "p5_files": "select cast(sum(length(extracted_text) + 2) as bigint) as characters, cast(0 as bigint) as over_limit from file_embedding",
    "p7_percentiles": _TIMINGS.format(day=f"{_DAY} as day,", part=f", {_DAY}", out="r.day,", error=", 0.0::double as error"),
    "p7_stage_percentiles": _TIMINGS.format(day="", part="", out="", error=""),
    "p7_bounds": _TIMINGS.format(day="", part="", out="", error=", true as held, true as close"),
    "p8_checked": "select limit_name, (select count(*) from documents) as texts, 0 as cut_needlessly, 0 as with_gaps, 0 as over_capacity, (select count(*) from documents where coalesce(text, '') = '') as without_container from size_limits where limit_name like 'pack_%' and unit = 'tokens'",
    "p9_checked": "select source, 0 as over_cap, 0 as repeated, 0 as misplaced from (select distinct source from documents where text <> '') join mix_targets using (source) where target_share > 0 and max_repeats > 0",
}
