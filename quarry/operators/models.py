"""Embedders and rerankers. Both are plug points with deterministic defaults that need no model file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import passage, question, tokens
from ..ship import ship

#: Turns texts into vectors, or (query, text) pairs into scores. Built by a factory, see once().
Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[tuple[str, str]]], list[float]]


@dataclass(frozen=True)
class Named:
    """Factory of a model by its name or folder; the package that loads it is needed on the workers only."""

    kind: str
    name: str

    def __call__(self):
        import sentence_transformers as st

        if self.kind == "rerank":
            scorer = st.CrossEncoder(self.name)
            return lambda pairs: [float(x) for x in scorer.predict(pairs)]
        encoder = st.SentenceTransformer(self.name)
        return lambda texts: encoder.encode(texts, normalize_embeddings=True).tolist()


def named(kind: str, name: str) -> Named | None:
    """None, for the native default, if no name is given."""
    return Named(kind, name) if name else None


_loaded: dict[object, object] = {}


def once(factory: Callable):
    """The factory's model. That of a named one, or of a module's function, is loaded once a worker process and kept between its tasks;
    a local function may hold anything, so its model is made once a task."""
    place = getattr(factory, "__qualname__", "<locals>")
    key = factory if isinstance(factory, Named) else None if "<" in place else (factory.__module__, place)
    if key is None:
        return factory()
    if key not in _loaded:
        _loaded[key] = factory()
    return _loaded[key]


def hashed_embedding(text: Column, dim: int) -> Column:
    """Unit vector of token counts in dim columns, by md5 of the token: native, for tests and offline use."""
    place = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
    return F.transform(F.element_at(F.transform(F.array(counts), vectors.unit), 1), lambda x: x.cast("float"))


def embed(df: DataFrame, text: Column, factory: Callable[[], Embed] | None = None, dim: int = 64, role: str = "passage", batch: int = 64, out: str = "embedding") -> DataFrame:
    """df with a vector column. A factory's model is fed batch texts at a time."""
    text = (passage if role == "passage" else question)(text)
    if factory is None:
        return df.withColumn(out, hashed_embedding(text, dim))
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(factory)
        for part in parts:
            texts = part.tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])], index=part.index)

    return df.withColumn(out, run(text))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the first 1,500 characters have; the default reranker."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(F.left(text, F.lit(1500))))) / F.greatest(F.size(asked), F.lit(1))


def rerank_score(df: DataFrame, query: str, factory: Callable[[], Score] | None = None, out: str = "ce") -> DataFrame:
    if factory is None:
        return df.withColumn(out, lexical_score(F.lit(query), F.col("text")))
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(factory)
        for part in parts:
            yield pd.Series(model([(query, t) for t in part.tolist()]), index=part.index, dtype="float64")

    return df.withColumn(out, run(F.left("text", F.lit(1500))))
