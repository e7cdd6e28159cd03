"""Hybrid search over a chunks table."""

from __future__ import annotations

import hashlib
import json
import os
import threading
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import paths, vectors
from ..functions.text import indexed_text
from ..plans.store import Store
from . import fusion, lexical, models


def current_dir(cwd: str | None = None) -> str:
    try:
        return os.path.realpath(cwd or os.getcwd())
    except OSError:
        return os.path.expanduser("~")


def repo_of_dir(repos: tuple[str, ...], cwd: str | None = None) -> str | None:
    """Name of the first configured repo that is the folder or above it."""
    here = current_dir(cwd)
    for r in repos:
        base = os.path.realpath(r)
        if here == base or here.startswith(base + os.sep):
            return os.path.basename(base)
    return None


def scopes(scope_types, scope_repos, settings: Settings, cwd: str | None = None) -> tuple[list[str] | None, list[str] | None]:
    """Types and repos as lists or None (all). A string is one name; ["all"] is all; no repos at all means that of the folder."""
    types = [scope_types] if isinstance(scope_types, str) else list(scope_types) if scope_types else None
    repos = [scope_repos] if isinstance(scope_repos, str) else list(scope_repos) if scope_repos else None
    types = None if types == ["all"] else types
    if repos == ["all"]:
        return types, None
    if repos is None and (own := repo_of_dir(settings.repos, cwd)):
        repos = [own]
    return types, repos


def scoped(chunks: DataFrame, types: list[str] | None = None, repos: list[str] | None = None) -> DataFrame:
    """Filters that reach the scan. A chunk without repo is in no repo's scope."""
    out = chunks
    if types:
        out = out.filter(F.col("source_type").isin(types))
    if repos:
        out = out.filter(F.col("repo").isin(repos))
    return out


def hits(ranked: DataFrame, reranked: bool) -> DataFrame:
    return ranked.select(
        "rank", F.round("score", 4).alias("rrf"), F.round("cos", 3).alias("cos"), F.round("bm25", 2).alias("bm25"), F.lit(reranked).alias("reranked"),
        "source_type", "repo", "language", "symbol", "path", "start_line", "end_line", "text", "id",
    )


@dataclass
class Engine:
    """Search with given settings, embedder and reranker (None: the native defaults).

    Each scope has an index that is made once: kept by the session, or, with index_root, stored there for others.
    """

    chunks: DataFrame
    settings: Settings = Settings()
    embed_factory: object = None
    rerank_factory: object = None
    index_root: str | None = None
    indexes: dict[str, lexical.Index] = field(default_factory=dict)
    store: Store | None = None
    stamp: int | None = None
    lock: object = field(default_factory=threading.RLock, repr=False, compare=False)

    @staticmethod
    def of_store(store: Store, settings: Settings) -> Engine:
        """An engine over the store's newest snapshot, with the models that the settings name."""
        engine = Engine(store.read(), settings, models.named("embed", settings.model), models.named("rerank", settings.rerank_model), store=store)
        engine.follow()
        return engine

    def follow(self) -> None:
        """Takes up a newer snapshot of the store; what was kept of the old one goes."""
        if self.store is not None and (now := self.store.current()) != self.stamp:
            with self.lock:
                self.release()
                self.chunks, self.index_root, self.stamp = self.store.read(), self.store.index_root(), now

    def warm(self) -> None:
        """Makes what the first question would wait for: the indexes of the usual scopes, and the models on the workers."""
        self.follow()
        own = scopes(None, None, self.settings)
        for types, repos in (own, (list(self.settings.knowledge_scope), None)):
            self.index(types, repos)
        self.query_vector("warm")
        if self.settings.code_rerank:
            models.rerank_score(self.chunks.sparkSession.range(1).select(F.lit("warm").alias("text")), "warm", self.rerank_factory).collect()

    def index(self, types: list[str] | None, repos: list[str] | None) -> lexical.Index:
        """That of a scope; a caller that comes while it is made waits for it."""
        key = json.dumps([sorted(types or []), sorted(repos or [])])
        with self.lock:
            if key not in self.indexes:
                path = f"{self.index_root}/{hashlib.sha1(key.encode()).hexdigest()[:16]}" if self.index_root else None
                made = lexical.load(self.chunks.sparkSession, path) if path else None
                if made is None:
                    made = lexical.build(scoped(self.chunks, types, repos), "id", indexed_text(F.col("symbol"), F.col("text")))
                    made = made.save(path) if path else made
                self.indexes[key] = made
            return self.indexes[key]

    def release(self) -> None:
        """Forgets the kept indexes, as after a change of the chunks."""
        for made in self.indexes.values():
            made.release()
        self.indexes.clear()

    def query_vector(self, query: str) -> list[float]:
        spark = self.chunks.sparkSession
        row = models.embed(spark.range(1).select(F.lit(query).alias("q")), F.col("q"), self.embed_factory, self.settings.dim, "query").first()
        return list(row["embedding"])

    def _scored(self, found: DataFrame, index: lexical.Index, query: str, vector) -> DataFrame:
        """id, symbol, source_type, mtime, path, cos, bm25 of the scoped chunks."""
        cos = found.select("id", "symbol", "source_type", "mtime", "path", vectors.dot(F.col("embedding"), vectors.literal(vector)).alias("cos"))
        return cos.join(lexical.score_one(index, query), "id", "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))

    def ranks(self, query: str, top: int, scope_types=None, scope_repos=None) -> DataFrame:
        """id, path, rank_cos, rank_bm25, named of what fusion chooses from, before it weighs anything."""
        self.follow()
        types, repos = scopes(scope_types, scope_repos, self.settings)
        index = self.index(types, repos)
        found = fusion.in_windows(self._scored(scoped(self.chunks, types, repos), index, query, self.query_vector(query)), index.n, top, query)
        return found.select("id", "path", "rank_cos", "rank_bm25", "named")

    def search(self, query: str, top: int = 5, scope_types=None, scope_repos=None, cwd: str | None = None, rerank: bool | None = None, vector=None) -> DataFrame:
        """Hits, best first. Scores come first, from the columns they need; texts are fetched for the best only."""
        self.follow()
        spark = self.chunks.sparkSession
        types, repos = scopes(scope_types, scope_repos, self.settings, cwd)
        found = scoped(self.chunks, types, repos)
        empty = lambda: hits(self.chunks.limit(0).select("*", F.lit(0).alias("rank"), *[F.lit(0.0).alias(c) for c in ("score", "cos", "bm25")]), False)
        if not (query or "").strip():
            return empty()
        index = self.index(types, repos)
        n = index.n
        if not n:
            return empty()
        vector = self.query_vector(query) if vector is None else vector
        narrow = self._scored(found, index, query, vector).persist()
        try:
            if self.settings.hybrid:
                fused = fusion.fuse(narrow, n, top, query, self.settings)
            else:
                fused = narrow.withColumn("score", F.col("cos"))
            again = rerank
            if again is None:
                two = narrow.select("cos").orderBy(F.desc("cos")).limit(2).agg(F.max("cos").alias("a"), F.when(F.count("*") > 1, F.min("cos")).otherwise(0.0).alias("b"))
                again = two.select(fusion.wants_rerank(F.col("a"), F.col("b"), types, self.settings)).first()[0]
            first = fusion.rerank_size(n, top) if again else top
            best = fused.select("id", "score", "cos", "bm25").orderBy(F.desc(F.round("score", 9)), "id").limit(first).collect()
        finally:
            narrow.unpersist()
        ids = spark.createDataFrame([tuple(r) for r in best], "id long, score double, cos double, bm25 double")
        full = found.filter(F.col("id").isin([r["id"] for r in best])).join(F.broadcast(ids), "id")
        done = False
        if again:
            try:  # the model runs at an action: its failure must show here, not in the caller's
                scored = models.rerank_score(full, query, self.rerank_factory).select("id", "ce").collect()
                full = full.drop("score").join(F.broadcast(spark.createDataFrame([tuple(r) for r in scored], "id long, score double")), "id")
                done = True
            except Exception:
                done = False
        ranked = full.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id"))).filter(F.col("rank") <= top)
        return hits(ranked, done).orderBy("rank")

    def knowledge(self, query: str, top: int = 5) -> DataFrame:
        return self.search(query, top, list(self.settings.knowledge_scope), ["all"], rerank=False)

    def recall(self, prompt: str, threshold: float = 0.55) -> DataFrame:
        """Automatic recall: two hits at most, of cosine threshold or more, 300 characters each."""
        fits = self.chunks.sparkSession.range(1).select(paths.prompt_fits(F.lit(prompt))).first()[0]
        found = self.search(prompt if fits else "", 2, rerank=False)
        return found.filter(F.col("cos") >= threshold).withColumn("text", F.left("text", F.lit(300)))

    def with_settings(self, **changes) -> Engine:
        return replace(self, settings=replace(self.settings, **changes))


def score_order(column: str) -> list[Column]:
    return [F.desc(F.round(column, 9)), F.col("id").asc()]
