"""Literal, semantic and hybrid search over catalogue, contents and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.functions import columns as C
from driftnet.functions import vectors as V

MODES = ("literal", "semantic", "hybrid")
BOOST = 0.15
MOST_NEIGHBOURS = 400
RESULT = ("path", "filename", "size", "score", "snippet", "kind")


def representatives(catalog: DataFrame) -> DataFrame:
    """One live file a content: the one with the shortest path, then the first by name. One shuffle, combined before it."""
    rows = catalog.where(C.live(F.col("deleted_at")) & F.col("content_hash").isNotNull())
    best = F.min_by(F.struct("id", "path", "filename", "size_bytes"), F.struct(F.length("path"), F.col("path")))
    return rows.groupBy("content_hash").agg(best.alias("file")).select("content_hash", "file.*")


def literal(catalog: DataFrame, term: str, limit: int) -> DataFrame:
    """Live files whose name or path holds the term, short names first; 0.9 for a hit in the name, 0.6 in the path."""
    hit = C.like_contains(F.col("filename"), term) | C.like_contains(F.col("path"), term)
    score = F.when(F.contains(F.lower("filename"), F.lower(F.lit(term))), 0.9).otherwise(0.6)
    return (
        catalog.where(C.live(F.col("deleted_at")) & hit)
        .orderBy(F.length("filename"), "path").limit(limit)
        .select("path", "filename", F.coalesce("size_bytes", F.lit(0)).alias("size"), score.alias("score"), F.lit("").alias("snippet"), F.lit("").alias("kind"), F.length("filename").alias("_order"))
    )


def nearest(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k contents nearest to the query: columns content_hash, squared. Exact, over all vectors of the query's length;
    ties go by content. The top k of each partition is kept before anything moves."""
    usable = vectors.where(F.size("embedding") == len(query))
    return usable.select("content_hash", V.distances_to(query)("embedding").alias("squared")).orderBy("squared", "content_hash").limit(k)


def semantic(catalog: DataFrame, contents: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """The contents nearest to the query, each by its representative file.

    k = min(8 * limit, 400) neighbours are taken before it is known which of them are live: the surplus makes up for
    contents that only deleted files carry. At most 400 rows go into the joins, so they are sent to the other sides.
    """
    found = nearest(vectors, query, min(8 * limit, MOST_NEIGHBOURS)).collect()  # at most MOST_NEIGHBOURS rows, found once
    near = catalog.sparkSession.createDataFrame(found, "content_hash string, squared double")
    few = F.broadcast(near)
    texts = contents.join(few, "content_hash").select("content_hash", "squared", "extracted_text", "source_kind")
    files = representatives(catalog.join(F.broadcast(near.select("content_hash")), "content_hash", "left_semi"))
    return texts.join(files, "content_hash").select(
        "path", "filename", F.coalesce("size_bytes", F.lit(0)).alias("size"), V.similarity(F.col("squared")).alias("score"),
        C.snippet(F.coalesce("extracted_text", F.lit(""))).alias("snippet"), F.coalesce("source_kind", F.lit("")).alias("kind"), F.col("squared").alias("_order"),
    )


def merge(lit: DataFrame, sem: DataFrame, limit: int) -> DataFrame:
    """Hits of both sides by path: in both, the better score plus 0.15, at most 1; equal scores put literal hits first."""
    a, b = lit.alias("a"), sem.alias("b")
    both = F.col("a.path").isNotNull() & F.col("b.path").isNotNull()
    score = F.when(both, F.least(F.greatest("a.score", "b.score") + BOOST, F.lit(1.0))).otherwise(F.coalesce("a.score", "b.score"))
    out = a.join(b, F.col("a.path") == F.col("b.path"), "full").select(
        F.coalesce("a.path", "b.path").alias("path"), F.coalesce("a.filename", "b.filename").alias("filename"), F.coalesce("a.size", "b.size").alias("size"),
        score.alias("score"), F.coalesce("b.snippet", "a.snippet").alias("snippet"), F.coalesce("b.kind", "a.kind").alias("kind"),
        F.when(F.col("a.path").isNotNull(), 0).otherwise(1).alias("_side"), F.coalesce(F.col("a._order").cast("double"), F.col("b._order")).alias("_order"),
    )
    return out.orderBy(F.desc("score"), "_side", "_order", "path").limit(limit).select(*RESULT)


def search(
    catalog: DataFrame, contents: DataFrame, vectors: DataFrame, term: str, mode: str = "hybrid", limit: int = 20,
    embed: Callable[[list[str]], list[Sequence[float]]] | None = None, degraded: list[str] | None = None,
) -> DataFrame:
    """Search by name, by meaning, or both. A failing embedder leaves the literal hits and names its reason in ``degraded``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    term = term.strip()
    lit = literal(catalog, term, limit)
    plain = lit.orderBy(F.desc("score"), "_order", "path").limit(limit).select(*RESULT)
    if not term:
        return plain.limit(0)
    if mode == "literal":
        return plain
    try:
        query = embed([term])[0] if embed else None
        if query is None:
            raise RuntimeError("no embedding backend")
    except Exception as problem:  # whatever a model does, names can still be searched
        if degraded is not None:
            degraded.append(str(problem))
        return plain if mode == "hybrid" else plain.limit(0)
    sem = semantic(catalog, contents, vectors, query, limit)
    return merge(lit.limit(0) if mode == "semantic" else lit, sem, limit)
