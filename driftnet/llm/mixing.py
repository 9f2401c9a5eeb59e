"""Mixing sources to target weights by systematic sampling (problem 9).

Every text of a source is expected the same number of times, the source's rate. Expected copies are prefix-summed over the
source's texts in order of size, one random offset is added, and a text comes out once for every integer boundary its own
stretch crosses: each text is used floor(rate) or ceil(rate) times. A text that alone holds more than ``LARGE`` of what its
source is to contribute would make the share a matter of luck; its expectation is a whole number, the rate rounded, and the
other texts' rate makes up for it. The prefix sum has two levels (rank within a bucket, sum over the buckets before), so no
source is ever put in one window.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.runtime import materialize

BUCKET_ROWS = 50_000
LARGE = 0.05
ROUNDS = 8
#: The mixture isn't made smaller than this part of what the caps allow; beyond it a source falls short instead.
LEAST = 0.5


def distinct_texts(df: DataFrame, key: str, source: str, text: str, size) -> DataFrame:
    """Columns key, source, size: exact copies of a text are one text, kept under its smallest key; empty texts hold nothing.

    ``max_repeats`` limits the uses of a text, so copies under other keys must not add to them."""
    t = F.col(text)
    rows = df.where(F.col(key).isNotNull() & F.col(source).isNotNull() & (F.length(t) > 0))
    rows = rows.select(F.sha2(t, 256).alias("_h"), F.struct(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")).alias("_r"))
    return rows.groupBy("_h").agg(F.min("_r").alias("_r")).select("_r.*").where(F.col("size") > 0)


def plan(totals: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """The rate of each source: how often a text of it is expected.

    Without ``total`` the mixture is as large as the caps allow while every source that has texts reaches its share of it;
    with ``total`` a source that would need more than its cap stops at the cap and its shortfall is reported.
    totals: (size, texts) by source; targets: (source, share, max_repeats).
    """
    own = [(s, share, cap) for s, share, cap in targets if totals.get(s, (0, 0))[0] > 0 and share > 0 and cap > 0]
    if not own:
        return {}
    weight = sum(share for _, share, _ in own)
    if total is None:
        total = min(totals[s][0] * cap * weight / share for s, share, cap in own)
    return {s: min(float(cap), total * share / weight / totals[s][0]) for s, share, cap in own}


def mix(texts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20_240) -> DataFrame:
    """Columns key, source, size, copies (at least 1): the selection; sources without a target are not part of it.

    ``texts`` has key, source, size, one row a text (:func:`distinct_texts`); it is read several times, so materialize it
    where it is costly. ``targets`` has source, target_share, max_repeats and is a parameter table of a row a source, which is
    brought to the driver; a source named twice there is an error. Targets of absent sources are left to the others in
    proportion. Ties in size go by key. An empty table gives no rows.
    """
    spark = texts.sparkSession
    want = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    if len({s for s, _, _ in want}) != len(want):
        raise ValueError("a source has several targets")
    named = texts.where(F.col("source").isin([s for s, _, _ in want]))
    stats = {r["source"]: (r["n"], r["c"]) for r in named.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c")).collect()}
    rates = plan(stats, want, total)
    caps = {s: cap for s, _, cap in want}
    rng = random.Random(seed)
    if not rates:
        return texts.limit(0).withColumn("copies", F.lit(0))
    kept = 1.0
    for _ in range(ROUNDS):
        goal = {s: rates[s] * stats[s][0] for s in rates}
        cuts = spark.createDataFrame([(s, LARGE * goal[s]) for s in rates], "source string, _large double")
        large = named.join(F.broadcast(cuts), "source").where(F.col("size") > F.col("_large"))  # a row a target
        held = {r["source"]: r["n"] for r in large.groupBy("source").agg(F.sum("size").alias("n")).collect()}
        whole = {s: min(caps[s], int(rates[s] + 0.5)) for s in rates}
        fits = {s: (whole[s] * held.get(s, 0) + caps[s] * (stats[s][0] - held.get(s, 0))) / goal[s] for s in rates}
        shrink = min(fits.values())
        if total is not None or shrink > 0.999 or kept * shrink < LEAST:
            break
        kept *= shrink
        # some source's other texts can't make up for its large ones: a smaller mixture, in which all reach their shares
        rates = {s: rates[s] * shrink for s in rates}
    rows = []
    for s in sorted(rates):
        rest = stats[s][0] - held.get(s, 0)
        rate_ = min(float(caps[s]), max(0.0, goal[s] - whole[s] * held.get(s, 0)) / rest) if rest else 0.0
        rows.append((s, rate_, rng.random(), caps[s], LARGE * goal[s], whole[s], max(1, -(-stats[s][1] // BUCKET_ROWS))))
    rate = spark.createDataFrame(rows, "source string, _rate double, _offset double, _cap int, _large double, _whole int, _parts int")
    own = named.join(F.broadcast(rate), "source")
    big = own.where(F.col("size") > F.col("_large")).select("key", "source", "size", F.col("_whole").alias("copies"))
    own = own.where(F.col("size") <= F.col("_large"))
    # buckets follow size (eighths of a doubling), each dealt to as many parts as the source is large
    own = own.withColumn("_class", F.floor(F.log2(F.col("size").cast("double")) * 8)).withColumn("_part", F.pmod(F.xxhash64("key"), F.col("_parts")))
    bucket = ["source", "_class", "_part"]
    before = own.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*bucket).orderBy("size", "key"))
    own = own.withColumn("_at", rank).join(before, bucket)
    i = F.col("_before") + F.col("_at")
    upto = F.floor(F.col("_offset") + F.col("_rate") * i)
    copies = F.least(upto - F.floor(F.col("_offset") + F.col("_rate") * (i - 1)), F.col("_cap").cast("long"))
    return own.select("key", "source", "size", copies.cast("int").alias("copies")).unionByName(big).where(F.col("copies") > 0)


def reached_shares(selection: DataFrame, texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Columns source, target_share, max_repeats, texts_available, texts_used, size_used, reached_share, most_repeats: one
    row a target, with zeros for sources that are absent."""
    used = selection.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts_used"), F.sum(F.col("size") * F.col("copies")).alias("size_used"), F.max("copies").alias("most_repeats")
    )
    have = texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts_available"))
    out = targets.join(have, "source", "left").join(used, "source", "left").na.fill(0, ["texts_available", "texts_used", "size_used", "most_repeats"])
    everything = F.sum("size_used").over(Window.partitionBy(F.lit(1)))  # over a row a target
    return out.select(
        "source", "target_share", "max_repeats", "texts_available", "texts_used", "size_used",
        F.when(everything > 0, F.col("size_used") / everything).otherwise(0.0).alias("reached_share"), "most_repeats",
    )


def sized_texts(df: DataFrame, targets: DataFrame, key: str, source: str, text: str, size) -> DataFrame:
    """Distinct texts of the targeted sources with their sizes, materialized."""
    names = [r[0] for r in targets.select("source").collect()]
    return materialize(distinct_texts(df.where(F.col(source).isin(names)), key, source, text, size), "mix")
