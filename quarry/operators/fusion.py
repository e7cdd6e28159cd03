"""Weighted reciprocal-rank fusion and the priors that are added to it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import identifiers


def window_size(n: int, top: int) -> int:
    return min(n, max(top * 16, 80))


def rerank_size(n: int, top: int) -> int:
    return min(n, max(top * 4, 20))


def leading(scored: DataFrame, score: str, rank: str, limit: int) -> DataFrame:
    """id and rank of the limit best rows. The limit comes first, so only its rows meet in one task."""
    best = scored.select("id", F.round(score, 9).alias("_s")).orderBy(F.desc("_s"), "id").limit(limit)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc("_s"), "id")).alias(rank))


def everywhere(scored: DataFrame, score: str, rank: str) -> DataFrame:
    """id and rank of all rows. They are sorted by ranges; a row's rank is its place in its range behind the rows of the ranges before."""
    at = scored.select("id", F.round(score, 9).alias("_s")).orderBy(F.desc("_s"), "id").select("id", F.monotonically_increasing_id().alias("_at")).persist()
    part, sizes = F.shiftright("_at", 33), {}
    for r in at.groupBy(part.alias("part")).count().collect():  # a row a range
        sizes[r["part"]] = r["count"]
    before = [0, *accumulate(sizes.get(k, 0) for k in range(max(sizes, default=0) + 1))]
    return at.select("id", (F.get(F.lit(before).cast("array<long>"), part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(rank))


def rrf(rank_cos: Column, rank_bm25: Column, settings: Settings) -> Column:
    one = lambda r, w: F.coalesce(F.lit(w) / (settings.rrf_k + r), F.lit(0.0))
    return one(rank_cos, 1.0) + one(rank_bm25, settings.bm25_weight)


def symbol_named(symbol: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(symbol).isin(words), F.lit(False)) if words else F.lit(False)


def boost(named: Column, settings: Settings) -> Column:
    """One first rank's worth for chunks whose symbol the query names."""
    return F.when(named, 1.0 / (settings.rrf_k + 1)).otherwise(0.0)


def query_words(spark, query: str) -> list[str]:
    return spark.range(1).select(identifiers(F.lit(query))).first()[0]


def recency(source_type: Column, mtime: Column, newest: Column, settings: Settings) -> Column:
    """Up to weight first ranks for memory notes, falling to 0 over the recency window."""
    age = (newest - mtime) / (settings.recency_days * 86400.0)
    fresh = settings.recency_weight * F.greatest(F.lit(0.0), 1 - age) / (settings.rrf_k + 1)
    return F.when((source_type == "memory") & (mtime != 0), fresh).otherwise(0.0)


def in_windows(scored: DataFrame, n: int, top: int, query: str) -> DataFrame:
    """scored with rank_cos, rank_bm25 (null outside of the window) and named (the query names the symbol), for rows that have one of them."""
    width, words = window_size(n, top), query_words(scored.sparkSession, query)
    # the windows' rows are a few times top, whatever the corpus
    ranked = scored.join(F.broadcast(leading(scored, "cos", "rank_cos", width)), "id", "left").join(F.broadcast(leading(scored, "bm25", "rank_bm25", width)), "id", "left")
    ranked = ranked.withColumn("named", symbol_named(F.col("symbol"), words))
    return ranked.filter(F.col("rank_cos").isNotNull() | F.col("rank_bm25").isNotNull() | F.col("named"))


def fuse(scored: DataFrame, n: int, top: int, query: str, settings: Settings) -> DataFrame:
    """scored (id, cos, bm25, symbol, source_type, mtime) with score, for rows in either window or with a boost."""
    found = in_windows(scored, n, top, query)
    found = found.withColumn("score", rrf(F.col("rank_cos"), F.col("rank_bm25"), settings) + boost(F.col("named"), settings))
    if settings.recency_weight > 0:
        newest = found.filter(F.col("source_type") == "memory").agg(F.max("mtime")).first()[0]
        if newest:
            found = found.withColumn("score", F.col("score") + recency(F.col("source_type"), F.col("mtime"), F.lit(newest), settings))
    return found


def wants_rerank(top1: Column, top2: Column, scope: list[str] | None, settings: Settings) -> Column:
    """The choice for callers that made none, by the two best cosines."""
    technical = bool(scope) and all("code" in s or "standards" in s for s in scope)
    if settings.rerank or settings.code_rerank and technical:
        return F.lit(True)
    if not settings.rerank_auto or settings.code_rerank:
        return F.lit(False)
    return (top1 < settings.rerank_threshold) | (top1 - top2 < settings.rerank_margin)
