"""Quality scores by Bradley-Terry ranking.

A labelled-good text is preferred to a labelled-bad one. The chance that a is preferred to b is sigmoid(s(a) - s(b)) with a score
s that is linear in hinges of the text statistics; the logistic loss on the differences is minimised by Newton's method over
pairs of a bounded sample. The cut is a quantile of the training scores, so that as large a share lies above as has label 1.
Scoring is one native expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textstats import FEATURES, features, text_counts

#: Labelled rows to fit on, drawn by a hash of doc_id, and pairs of each; the only sample.
MOST_ROWS, PAIRS, RIDGE, THRESHOLD = 20_000, 4, 1.0, 0.7
KNOTS = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


@dataclass
class Ranking:
    """score = sum of weight * max(feature - knot, 0) (a null knot: the feature itself)."""

    terms: list[tuple[str, float | None, float]]
    cut: float
    scale: float

    def raw(self) -> Column:
        out = F.lit(0.0)
        for name, knot, weight in self.terms:
            x = F.col(name) if knot is None else F.greatest(F.col(name) - knot, F.lit(0.0))
            out = out + x * weight
        return out

    def score(self) -> Column:
        """0 to 1; THRESHOLD at the cut."""
        z = (self.raw() - self.cut) / self.scale + float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def fit_pairs(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights of the differences good - bad, paired by fixed shifts of the smaller side against the larger."""
    m = max(len(good), len(bad))
    rows = []
    for k in range(PAIRS):
        shift = (k * 7919) % m
        rows.append(good[np.arange(m) % len(good)] - bad[(np.arange(m) + shift) % len(bad)])
    d = np.concatenate(rows)
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        grad = d.T @ p - ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), grad)
        size = np.abs(step).max()
        w += step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def fit_ranking(rows: list, names: tuple[str, ...] = FEATURES) -> Ranking:
    """rows: (label, features...) in a fixed order. With one label only, all scores are at the cut."""
    table = np.array([[float(v) for v in r] for r in rows], dtype=np.float64).reshape(len(rows), 1 + len(names))
    label, x = table[:, 0] == 1, table[:, 1:]
    if not label.any() or label.all():
        return Ranking([], 0.0, 1.0)
    cols, terms = [], []
    for k, name in enumerate(names):
        for knot in [None, *np.unique(np.quantile(x[:, k], KNOTS)).tolist()]:
            col = x[:, k] if knot is None else np.maximum(x[:, k] - knot, 0)
            if col.std() > 1e-9:
                cols.append(col)
                terms.append((name, knot, float(col.std())))
    z = np.stack(cols, axis=1) / np.array([t[2] for t in terms])
    w = fit_pairs(z[label], z[~label])
    scores = z @ w
    cut = float(np.quantile(scores, 1 - label.mean()))
    return Ranking([(n, k, float(v / s)) for (n, k, s), v in zip(terms, w, strict=True)], cut, float(max(scores.std() / 4, 1e-9)))


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Learns from labels (doc_id, quality 0 or 1) of documents whose crc32(doc_id as text) mod 4 is not 2; a null doc_id teaches
    nothing and isn't held out. Of several labels of one doc_id the worst counts, once. If more than most_rows are labelled, those of
    the least hashes of doc_id are read. Null and empty texts have the statistics of an empty text and get its score; a very long
    text is counted whole. A score at the cut is predicted 1, so ties fall to one side. Without labels all scores are THRESHOLD. Rows
    that repeat a doc_id are scored one by one. An empty table gives no rows. Other columns are ignored.
    """
    counted = text_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    counted = materialize(counted.select("doc_id", held.alias("held_out"), *[c.alias(n) for n, c in features().items()]), "counts")
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).filter("_q in (0, 1)").groupBy("_id").agg(F.min("_q").alias("_q"))
    train = materialize(counted.filter("not held_out and doc_id is not null").join(marked, F.col("doc_id") == F.col("_id")).select("doc_id", "_q", *FEATURES), "labelled")
    rows = train.orderBy(F.xxhash64("doc_id"), "doc_id", "_q", *FEATURES).limit(most_rows).select("_q", *FEATURES).collect()
    model = fit_ranking(sorted(map(tuple, rows)))
    scored = counted.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
