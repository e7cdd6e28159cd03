"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to 4 code points, lower-cased, are hashed into 2**BITS columns. A bounded sample of labelled texts gives the counts of
each language; the matrix of log probabilities (languages x columns, float32) is broadcast, and a batch is scored by gathering
the columns of its n-grams and summing them by text. Slices bound the memory, also for one very long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize
from .shingles import mix

ORDERS, BITS, SLICE_CHARS = (1, 2, 3, 4), 16, 1 << 18
#: Documents and characters of labelled text that a language's counts come from, on average at most; drawn by a hash of doc_id. The only
#: sample, a parameter of identify.
SAMPLE_DOCS, SAMPLE_CHARS, ALPHA = 4000, 8_000_000, 0.5
STEP = mix(np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def columns(points: np.ndarray, ends: np.ndarray):
    """(columns, text number) of the n-grams of texts laid end to end; n-grams don't cross texts. One order at a time."""
    values = points.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    total = None
    for n in ORDERS:
        m = len(values) - n + 1
        if m <= 0:
            return
        total = values * STEP[0] if n == 1 else total[:m] + values[n - 1 :] * STEP[n - 1]
        mixed = total * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        found = (mixed >> np.uint64(64 - BITS)).astype(np.int32)
        inside = owner[:m] == owner[n - 1 :]
        yield (found, owner[:m]) if inside.all() else (found[inside], owner[:m][inside])


def slices(texts):
    """(numbers of texts, code points, ends): many short texts at once, or parts of a long one that overlap by no n-gram lost."""
    numbers, parts, size = [], [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)

        if len(points) > SLICE_CHARS:
            reach = max(ORDERS) - 1
            for low in range(0, len(points), SLICE_CHARS):
                yield [k], points[max(0, low - reach) : low + SLICE_CHARS], np.array([len(points[max(0, low - reach) : low + SLICE_CHARS])]), min(low, reach)
            continue
        numbers.append(k)
        parts.append(points)
        size += len(points)
        if size >= SLICE_CHARS:
            yield numbers, np.concatenate(parts), np.cumsum([len(p) for p in parts]), 0
            numbers, parts, size = [], [], 0
    if parts:
        yield numbers, np.concatenate(parts), np.cumsum([len(p) for p in parts]), 0


def _grams(texts):
    """(text numbers, columns, owners) with each n-gram once: of a later part of a long text only n-grams that end in it anew."""
    for numbers, points, ends, old in slices(texts):
        for n, (found, owner) in zip(ORDERS, columns(points, ends), strict=False):
            skip = max(0, old - n + 1)
            yield numbers, found[skip:], owner[skip:]


def _counts(langs: list[str]):
    place = {x: k for k, x in enumerate(langs)}

    def run(frames):
        total = np.zeros((len(langs), 1 << BITS), dtype=np.int64)
        for frame in frames:
            of = np.array([place[x] for x in frame.column("lang").to_pylist()])
            for numbers, found, owner in _grams(frame.column("text").to_pylist()):
                flat = of[np.array(numbers)][owner].astype(np.int64) << BITS | found
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        some = np.flatnonzero(total.ravel())
        for low in range(0, len(some), 50_000):
            part = some[low : low + 50_000]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part, pa.int64()), "n": pa.array(total.ravel()[part], pa.int64())})

    return run


def score_texts(texts: list[str | None], logs: np.ndarray) -> np.ndarray:
    """Log likelihood of each text in each language; logs: languages x columns."""
    out = np.zeros((len(texts), len(logs)))
    for numbers, found, owner in _grams(texts):
        at = np.array(numbers)
        for k in range(len(logs)):
            out[at, k] += np.bincount(owner, weights=logs[k][found], minlength=len(at))
    return out


def _predict(model, langs: list[str]):
    def run(frames):
        logs, prior = model.value
        for frame in frames:
            for low in range(0, frame.num_rows, 1024):
                part = frame.slice(low, 1024)
                texts = part.column("text").to_pylist()
                total = score_texts(texts, logs) + prior
                total -= total.max(axis=1, keepdims=True)
                share = np.exp(total)
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "lang_pred": pa.array([langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                        "score": pa.array([float(share[i, b]) if known[i] else 0.0 for i, b in enumerate(best)], pa.float64()),
                    }
                )

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score (posterior of lang_pred).

    Learns from rows of known lang whose crc32(doc_id as text) mod 3 is not 1; held_out is that remainder being 1 (false for a null
    doc_id, which teaches nothing). A text that is null or has no letter gets und and score 0, as has every text if nothing can
    be learned. The fit reads about sample_docs texts and sample_chars characters a language, whole texts, and always the one that its
    draw puts first. Ties go to the language that sorts first. A very long text is read in slices. Rows that repeat a doc_id are scored
    each. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 1) / F.lit(float(2**63))
    known = rows.filter("not held_out and lang is not null and doc_id is not null and text is not null").withColumn("draw", draw)
    sizes = known.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.char_length("text")).alias("chars"), F.min(F.when(F.char_length("text") > 0, F.col("draw"))).alias("first")).orderBy("lang").collect()
    langs = [r["lang"] for r in sizes]
    if not langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], max(r["first"] or 0.0, min(1.0, sample_docs / r["docs"], sample_chars / max(1, r["chars"])))).otherwise(share)
    sample = known.filter(F.col("draw") <= share).select("lang", "text")
    cells = materialize(sample.mapInArrow(_counts(langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "ngrams")
    found = cells.toArrow()  # at most languages x 2**BITS cells
    counts = np.zeros(len(langs) << BITS)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(langs), -1) + ALPHA
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    total = sum(r["docs"] for r in sizes)
    prior = np.log(np.array([r["docs"] / total for r in sizes]))
    model = spark.sparkContext.broadcast((logs, prior))
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(model, langs), "doc_id long, held_out boolean, lang_pred string, score double")
