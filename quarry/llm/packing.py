"""Packing documents into sequences by minimum bin slack.

Each document is cut after every LENGTH tokens; its full pieces fill a sequence each and only its last piece is packed. Pieces are
dealt into windows of bounded size. In a window, sequence after sequence, a subset-sum over the multiset of remaining lengths,
held as the bits of one integer, finds the fullest reachable sum; counts per length are traced back. Large lengths come first, so
that pieces which are hard to place leave early.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import materialize
from .tokens import END_ID, default_paths, encoder

LENGTH, WINDOW_DOCS = 1024, 4096
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("window", pa.int64())])


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset counts, with the greatest sum up to room. Longest lengths are decided first.

    Bit s of an integer says that sum s can be reached; a length with k copies is added in portions of 1, 2, 4, ... copies. From
    the greatest sum the portions are undone, last first, each time taking a portion only if the sum can't be reached without.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            k = min(part, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, part = left - k, part * 2
        if reach >> room & 1:
            break
    best, picked = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            picked[length] = picked.get(length, 0) + k
            best -= length * k
    return list(picked.items())


def fill(lengths: list[int], room: int) -> list[list[int]]:
    """Places of lengths, all in 1..room, for each sequence. The longest piece left opens a sequence, the rest is filled."""
    at: dict[int, list[int]] = {}
    for place, length in enumerate(lengths):
        at.setdefault(length, []).append(place)
    for places in at.values():
        places.reverse()
    counts, out = {length: len(p) for length, p in at.items()}, []

    def take(length: int, k: int) -> list[int]:
        counts[length] -= k
        if not counts[length]:
            del counts[length]
        return [at[length].pop() for _ in range(k)]

    while counts:
        longest = max(counts)
        now = take(longest, 1)
        for length, k in fullest(counts, room - longest):
            now += take(length, k)
        out.append(now)
    return out


def _pieces(paths: tuple[str, str], length: int, windows: int):
    def run(frames):
        encode, met = encoder(paths).ids, Counter()
        for frame in frames:
            for low in range(0, frame.num_rows, 512):
                rows = []
                part = frame.slice(low, 512)
                for doc, text, hashed in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("hashed").to_pylist(), strict=True):
                    ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                    again = met[doc, hashed]  # rows that repeat go to one window after another, as do a long text's pieces
                    met[doc, hashed] += 1
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), (hashed + again + start // length) % windows))
                yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, map(list, zip(*rows, strict=True)), strict=True)), schema=PIECES)

    return run


def _window(room: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True, na_position="first")
        sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
        lengths = frame["length"].to_numpy()
        for k, places in enumerate(fill(lengths.tolist(), room)):
            sequence[places] = k
            offset[places] = np.cumsum(lengths[places]) - lengths[places]
        frame["sequence_id"] = frame["window"].to_numpy() * (1 << 40) + sequence
        frame["offset"] = offset
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, length: int = LENGTH, window_docs: int = WINDOW_DOCS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and one END_ID; a null or empty text is END_ID alone; a very long text is encoded by
    itself and its full pieces never meet in a group. Rows that repeat a doc_id are packed each. Windows are dealt by a hash of doc_id
    and text, so reruns agree; repeated rows go to one window after another. Pieces of one length in a window are taken by doc_id and
    start. An empty table gives no rows. Other columns are ignored. Of a window at most the last few sequences have padding to speak of.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = max(1, -(-text.count() // window_docs))
    dealt = text.withColumn("hashed", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 8))
    pieces = dealt.mapInArrow(_pieces(paths or default_paths(), length, windows), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long")
    pieces = materialize(pieces, "pieces")
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    short = pieces.filter(F.col("length") < length).groupBy("window").applyInPandas(_window(length), columns)
    # a full piece is a sequence of its own; these are numbered from the middle of the window's numbers on
    nth = F.row_number().over(Window.partitionBy("window").orderBy("doc_id", "start", "ids_crc32"))
    full = pieces.filter(F.col("length") == length).withColumn("sequence_id", F.col("window") * (1 << 40) + (1 << 39) + nth).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(full.select(*short.columns))
