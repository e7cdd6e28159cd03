"""Some vectors of a table, as questions, against all others: the exact best rows of each question and the exact ranks of given rows.

Every pair is computed, in blocks that fit the processor's cache, by tasks that each take a share of the rows. A task holds the
questions (asked of them, each of dim doubles), what it knows of each so far, and one block of pairs. A dot product is the sum of its
products in their order, as SQL adds them, so copies of a vector have equal scores wherever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship

#: Questions and rows of a block of pairs; digits of a score that order rows.
ASKED, ROWS, DIGITS = 32, 2048, 9
#: Keys of a row without a vector (last in its order) and of a question's own row (not in it).
LAST, OWN = -(1 << 40), -(1 << 41)


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as doubles, and which of them are there. A null element adds nothing to a sum."""
    there, lengths = vectors.is_valid().to_numpy(zero_copy_only=False), pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) == 1 and lengths[0] and not vectors.flatten().null_count:
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths[0]).astype(np.float64), there
    out = np.zeros((len(there), max((n for n in lengths if n), default=0)))
    for k, v in enumerate(vectors.to_pylist()):
        out[k, : len(v or ())] = [0.0 if x is None else x for x in v or ()]
    return out, there


def dots(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dot products of all pairs, each summed in order."""
    by_place, dim = np.ascontiguousarray(rows.T), min(asked.shape[1], rows.shape[1])
    out, one = np.zeros((len(asked), len(rows))), np.empty((len(asked), len(rows)))
    for d in range(dim):
        np.multiply(asked[:, d, None], by_place[d][None, :], out=one)
        out += one
    return out


def keys(scores: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Scores rounded to DIGITS as whole numbers, so that equal ones compare as equal; halves go away from 0, as in SQL."""
    found = np.clip(np.nan_to_num(scores * 10.0**DIGITS, nan=1e12), -1e12, 1e12)
    return np.where(there, np.trunc(found + np.copysign(0.5, found)).astype(np.int64), LAST)


def _questions(asked: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = asked.select("id", "embedding").orderBy("id").toArrow().combine_chunks()
    vectors = table.column("embedding").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32()))
    return table.column("id").to_numpy(), *matrix(vectors)


def _blocks(frames: Iterator[pa.RecordBatch]):
    for frame in frames:
        for low in range(0, frame.num_rows, ROWS):
            part = frame.slice(low, ROWS)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            found, there = matrix(part.column("embedding"))
            yield ids[order], found[order], there[order]


def _dealt(rows: DataFrame) -> DataFrame:
    """A small table is a lot of work here: its rows are dealt to all cores, however few files it has."""
    return rows.select("id", "embedding").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "id")


def two_best(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, a, b: for each question (id, embedding) its best and second best dot product with all rows of other ids; null if none."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(_questions(asked))

    def run(frames):
        names, vectors, there = sent.value
        best = np.full((len(names), 2), -np.inf)
        count = np.zeros(len(names), dtype=np.int64)
        for ids, block, known in _blocks(frames):
            for low in range(0, len(names), ASKED):
                at = slice(low, low + ASKED)
                found = dots(vectors[at], block)
                out = (ids[None, :] == names[at][:, None]) | ~known[None, :] | ~there[at][:, None]
                found[out] = -np.inf
                count[at] += (~out).sum(axis=1)
                if found.shape[1] > 2:
                    found = np.partition(found, found.shape[1] - 2, axis=1)[:, -2:]
                best[at] = np.sort(np.concatenate([best[at], found], axis=1), axis=1)[:, -2:]
        for n, column in ((1, 1), (2, 0)):
            some = count >= n
            yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array(best[some, column], pa.float64())], ["query_id", "cos"])

    few = _dealt(rows).mapInArrow(run, "query_id long, cos double")  # two rows a question and task
    two = F.slice(F.sort_array(F.collect_list("cos"), asc=False), 1, 2)
    return few.groupBy("query_id").agg(two.alias("_two")).select("query_id", F.get("_two", 0).alias("a"), F.get("_two", 1).alias("b"))


def ranks(rows: DataFrame, asked: DataFrame, given: DataFrame, width: int) -> DataFrame:
    """case_id, id, rank: of each question (id, embedding) the width best rows and all rows of given (id, embedding), with their ranks
    by rounded dot product and id among all rows of other ids.

    A task sorts a block's rows for each question: its best ones go on, and the places of the given rows in the order say how many rows
    of the block are ahead of them. Sums of these are the given rows' ranks; given is held by each task, as the questions are.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((_questions(asked), _questions(given)))

    def run(frames):
        (names, vectors, there), (marks, at_marks, marked) = sent.value
        key, row = np.full((len(names), width), OWN, dtype=np.int64), np.zeros((len(names), width), dtype=np.int64)
        ahead = np.zeros((len(names), len(marks)), dtype=np.int64)
        limits = np.empty((len(names), len(marks)), dtype=np.int64)
        for low in range(0, len(names), ASKED):
            at = slice(low, low + ASKED)
            limits[at] = keys(dots(vectors[at], at_marks), marked[None, :] & there[at][:, None])
        for ids, block, known in _blocks(frames):
            n = len(ids)
            place, here = np.arange(n), np.searchsorted(ids, marks)
            for low in range(0, len(names), ASKED):
                at = slice(low, low + ASKED)
                found = keys(dots(vectors[at], block), known[None, :] & there[at][:, None])
                found[ids[None, :] == names[at][:, None]] = OWN
                codes = np.sort(found * (n + 1) + (n - place)[None, :], axis=1)  # larger is ahead: by key, then by the smaller id
                wanted = limits[at] * (n + 1) + (n - here)[None, :]
                for k in range(len(codes)):
                    ahead[low + k] += n - np.searchsorted(codes[k], wanted[k], side="right")
                lead = codes[:, -width:]
                new_key, new_row = (lead - 1) // (n + 1), ids[n - 1 - (lead - 1) % (n + 1)]
                all_keys, all_rows = np.concatenate([key[at], new_key], axis=1), np.concatenate([row[at], new_row], axis=1)
                order = np.lexsort((all_rows, -all_keys), axis=1)[:, :width]
                key[at], row[at] = np.take_along_axis(all_keys, order, 1), np.take_along_axis(all_rows, order, 1)
        for low in range(0, len(names), 256):
            at = slice(low, low + 256)
            case = np.repeat(names[at], width)
            real = key[at].ravel() != OWN
            yield batch(case[real], row[at].ravel()[real], key[at].ravel()[real], None)
            yield batch(np.repeat(names[at], len(marks)), np.tile(marks, len(names[at])), None, ahead[at].ravel())

    def batch(case, row, key, ahead):
        whole = lambda v: pa.nulls(len(case), pa.int64()) if v is None else pa.array(v, pa.int64())
        return pa.RecordBatch.from_arrays([whole(case), whole(row), whole(key), whole(ahead)], ["case_id", "id", "key", "ahead"])

    # dealt by question once: sums and order need no other shuffle
    parts = _dealt(rows).mapInArrow(run, "case_id long, id long, key long, ahead long").repartition("case_id")
    each = parts.groupBy("case_id", "id", "key").agg(F.sum("ahead").alias("ahead")).withColumn("leads", F.col("key").isNotNull())
    place = F.row_number().over(Window.partitionBy("case_id", "leads").orderBy(F.desc("key"), "id")).cast("long")
    kept = each.withColumn("rank", F.when(F.col("leads"), place).otherwise(F.col("ahead") + 1))
    kept = kept.filter(F.when(F.col("leads"), F.col("rank") <= width).otherwise(F.col("case_id") != F.col("id")))
    return kept.groupBy("case_id", "id").agg(F.min("rank").alias("rank"))
