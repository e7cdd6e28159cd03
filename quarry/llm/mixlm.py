"""Language-model scores by online logistic context mixing.

A text is its words and an end. Frequent words have a Huffman code; any other word is an escape and its bytes, which have a code
of their own, closed by a space. So a text is a series of bits, each at a node of a code tree, and the product of the bits'
probabilities is the text's. Three predictors give each bit's probability from counts under a context: the node alone, the node
hashed with the last word (or two bytes), and with the last two words (or four bytes). Their log odds are summed with weights
of a set that is gated by how sure the predictors are; the sum is refined by terms that each text adapts as it is read (weights
and, per gate, a bias), the bits before a segment teaching the segment (segments of FIRST bits, doubling up to SEGMENT). All
training texts are counted, and the weights are fitted on all of them, each read with tables that don't count it: a first fit on
some texts only saves steps, then Newton steps over both halves of the texts go on until they gain next to nothing. The slots of the hashed contexts grow in proportion
to the training tokens, coded and frequent words with the root of it. Counts are added by ranges of slots, sorted by range and read as
a stream; a large table's texts are counted in ROUNDS parts, so that the counts of one part at a time lie on disk before they are added.
The tables are a file that workers map, so no process holds them whole.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import heapq
import math
import os
import shutil
import tempfile
import uuid
from collections import Counter
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship, small_batches
from .common import materialize, release
from .shingles import IN_WORD, folded, mix, word_spans

#: Least of each: words with a code; words whose counts are broadcast (of at most WORD_BYTES each); slots of a hashed predictor.
CODED, FREQUENT, WORD_BYTES, SLOT_BITS = 130_000, 1 << 18, 64, 20
SLOTS, RANGE = 1 << SLOT_BITS, 1 << 16
FIRST, SEGMENT, SLICE_BYTES, PRIOR = 128, 512, 1 << 18, 200.0
#: Training tokens a slot, at most, up to MOST_BITS (slots and bits share 32 bits).
TOKENS_A_SLOT, MOST_BITS = 32, 31
#: Bits that a task gathers before it counts them; it counts in one array up to so many slots, else it sorts SORTED bits.
HELD, DENSE_BITS, SORTED = 1 << 22, 22, 1 << 23
#: Parts of the texts that are counted one after another where tasks sort; rows of counts that pass to Python at a time.
ROUNDS, ROWS = 4, 256
#: Least number of texts of the first fit of the weights; it grows with the root of the training texts. One in TUNING_SHARE at most.
TUNING_TEXTS, TUNING_SHARE = 128, 64
#: Newton steps over all training texts end when one gained less than GAIN of the loss, or after STEPS.
GAIN, STEPS = 1e-3, 20
GATES, CODE_NODES = 32, 1 << 18
#: Slices whose words are counted together, few enough for a small table; rows of such counts that a task adds up before it gives them on.
COUNTED_SLICES, COUNTED_WORDS = 8, 1_000_000
#: Bits that are looked up at a time, few enough for a processor's cache; bytes of freed memory that a worker keeps.
BLOCK, KEPT = 1 << 16, 1 << 26
END = b"\n"


class Lookup:
    """Places of 64-bit hashes, by open addressing in arrays. Equal hashes count as one word: a chance of about 1 in 10**13 a word."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(4, (2 * len(hashes) - 1).bit_length())
        self.keys, self.place = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(hashes)), self._start(hashes)
        while len(left):
            first = np.unique(at, return_index=True)[1]
            first = first[self.place[at[first]] < 0]
            self.keys[at[first]], self.place[at[first]] = hashes[left[first]], left[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _start(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        at = self._start(hashes)
        out = self.place[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.place[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != hashes[wrong])]
        return out


class Codes:
    """Bits and nodes of each symbol. Symbols: words by rank, escape, end, then 256 bytes."""

    def __init__(self, words: list[bytes], counts: list[int], other: int, ends: int, slot_bits: int = SLOT_BITS):
        self.slot_bits, self.slots = slot_bits, 1 << slot_bits
        self.n = n = min(len(words), coded_words(slot_bits))
        self.nodes = max(CODE_NODES, 1 << (n + 257).bit_length())
        self.lookup = Lookup(word_spans(words)[3] if words else np.empty(0, dtype=np.uint64))
        self.counts = np.array(counts, dtype=np.float64)
        spelled = Counter({b: 1 for b in range(256)})
        for w, c in zip(words[n:], counts[n:], strict=True):
            for b in w + b" ":
                spelled[b] += c
        if len(words) == n:  # no frequent word is spelled: take all
            for w in words:
                spelled.update(w + b" ")
        length, flat = zip(_huffman([*[max(1, c) for c in counts[:n]], max(1, other), max(1, ends)], 0), _huffman([spelled[b] for b in range(256)], n + 2), strict=True)
        self.length = np.concatenate(length)
        self.offset = np.cumsum(self.length) - self.length
        flat = np.concatenate(flat)
        spread = mix((flat >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) & np.uint64(self.slots - 1)
        #: Of each bit of each code, so that one look finds both: flat, and mark above it.
        spread <<= np.uint64(1)
        spread |= flat & np.uint64(1)
        spread <<= np.uint64(32)
        spread |= flat
        self.steps = spread

    @property
    def flat(self) -> np.ndarray:
        """Of each bit of each code: node * 2 + value."""
        return self.steps.astype(np.uint32)

    @property
    def mark(self) -> np.ndarray:
        """Of each bit of each code: the hash of its node * 2 + value."""
        return (self.steps >> np.uint64(32)).astype(np.uint32)


def coded_words(slot_bits: int) -> int:
    """Words with a code: they grow with the root of the slots, as a vocabulary does with its text."""
    return int(CODED * 2 ** ((slot_bits - SLOT_BITS) / 2))


def _huffman(counts: list[int], first_node: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of each symbol's code, and all codes in turn: node * 2 + bit from the root on. Ties go by order, so the code is a
    function of the counts."""
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up = np.zeros(2 * len(counts), dtype=np.int64)  # of each symbol or node: node above * 2 + bit
    for k in range(len(counts) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], len(counts) + k))
        up[a[1]], up[b[1]] = 2 * k, 2 * k + 1
    root = heap[0][1]
    length, at = np.zeros(len(counts), dtype=np.int32), np.arange(len(counts))
    while (on := at != root).any():
        length += on
        at = np.where(on, len(counts) + (up[at] >> 1), at)
    flat, end, at = np.zeros(int(length.sum()), dtype=np.uint64), np.cumsum(length, dtype=np.int64), np.arange(len(counts))
    left = np.flatnonzero(length)
    for k in range(1, int(length.max(initial=0)) + 1):
        left = left[length[left] >= k]
        step = up[at[left]]
        flat[end[left] - k] = step + 2 * first_node
        at[left] = len(counts) + (step >> 1)
    return length, flat


class Series:
    """The bits of some texts, with their nodes and hashed slots, and where each text's bits begin; beside these, ranks of all words
    and the words without one."""

    def __init__(self, codes: Codes, texts: list[bytes]):
        buf, first, long, hashes, self.n_words = word_spans(texts)
        self.rank, length_of = codes.lookup.find(hashes), long
        tokens = self.n_words + 1
        ends = np.cumsum(tokens)
        is_end = np.zeros(int(ends[-1]), dtype=bool)
        is_end[ends - 1] = True
        sym = np.empty(len(is_end), dtype=np.int64)
        sym[~is_end] = np.where((self.rank >= 0) & (self.rank < codes.n), self.rank, codes.n)
        sym[is_end] = codes.n + 1
        begin = np.zeros(len(is_end), dtype=bool)
        begin[ends - tokens] = True
        last = np.concatenate(([0], sym[:-1] + 1))
        last[begin] = 0
        before = np.concatenate(([0], last[:-1]))
        before[begin] = 0
        one = mix(last.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        two = mix(one + before.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(2))
        escaped = np.flatnonzero(sym == codes.n)
        at = np.arange(len(sym))
        if len(escaped):
            word_of = np.flatnonzero(~((self.rank >= 0) & (self.rank < codes.n)))
            long = long[word_of] + 1
            place = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
            raw = buf[np.repeat(first[word_of], long) + place].astype(np.uint64)
            raw[np.cumsum(long) - 1] = 32  # whatever white space ends it
            near = np.zeros(len(raw), dtype=np.uint64)
            hashes = []
            for k in range(1, 5):
                back = np.zeros(len(raw), dtype=np.uint64)
                back[k:] = raw[:-k]
                back[place < k] = 0
                near = near * np.uint64(257) + back + np.uint64(1)
                if k in (2, 4):
                    hashes.append(mix(near * np.uint64(2) + np.uint64(k // 2 + 10)))
            extra = np.zeros(len(sym), dtype=np.int64)
            extra[escaped] = long
            at = at + np.cumsum(extra) - extra
            total = len(sym) + len(raw)
            to = np.repeat(at[escaped], long) + 1 + place
            whole, h1, h2 = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.uint64), np.empty(total, dtype=np.uint64)
            whole[at], h1[at], h2[at] = sym, one, two
            whole[to], h1[to], h2[to] = raw.astype(np.int64) + codes.n + 2, hashes[0], hashes[1]
            sym, one, two = whole, h1, h2
        length = codes.length[sym]
        stop = np.cumsum(length, dtype=np.int64)
        at_step = np.repeat(codes.offset[sym] - (stop - length), length)
        at_step += np.arange(len(at_step))
        found = codes.steps.take(at_step, mode="wrap")
        flat = found.astype(np.uint32)
        found >>= np.uint64(32)
        mark = found.astype(np.uint32)
        keys = [np.repeat((h >> np.uint64(64 - codes.slot_bits)).astype(np.uint32) << np.uint32(1), length) for h in (one, two)]
        #: Of each bit: node * 2 + value, and slot * 2 + value of the hashed contexts.
        self.flat, self.key1, self.key2 = flat, np.bitwise_xor(keys[0], mark, out=keys[0]), np.bitwise_xor(keys[1], mark, out=keys[1])
        self.sym, self.nodes, self.slots = sym, codes.nodes, codes.slots
        self.spelled = codes.n + 1  # the first node of the tree of bytes
        starts = at[ends - tokens]
        self.start = (stop - length)[starts]
        self.bits = np.diff(np.append(self.start, stop[-1]))
        self.rare = np.flatnonzero(self.rank < 0)
        data = buf.tobytes() if len(self.rare) else b""
        self.rare_words = [data[a:b] for a, b in zip(first[self.rare].tolist(), (first + length_of)[self.rare].tolist(), strict=True)]


def packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds in 1/1024; the last two bits, a trifle of it, say how sure: 0 without counts, then under 4, under 32, or more."""
    n = n0 + n1
    odds = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -7.9, 7.9)
    return (np.rint(odds * 256).astype(np.int16) * 4 + (n > 0) + (n > 3) + (n > 31)).astype(np.int16)


def edges(low: int) -> int:
    """Where the segment that begins at a text's bit low ends."""
    return low + min(SEGMENT, max(FIRST, low))


def by_segments(start: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order in which bits are read: the first segment of all texts, then the second, and so on; of each segment the texts that have
    it and how many bits of them."""
    order, steps, low, on = [np.empty(0, dtype=np.int64)], [], 0, np.flatnonzero(bits)
    while len(on):
        high = edges(low)
        long = np.minimum(bits[on], high) - low
        order.append(np.repeat(start[on] + low - (np.cumsum(long) - long), long) + np.arange(int(long.sum())))
        steps.append((on, long))
        on, low = on[bits[on] > high], high
    return np.concatenate(order), steps


def _inputs(tables: np.ndarray, s: Series, order: np.ndarray | None = None):
    """Log odds of the three predictors (3 x bits), the gate and the value of each bit, in the order of the text or another."""
    n = len(s.flat) if order is None else len(order)
    odds, gate, bit = np.empty((3, n), dtype=np.float32), np.empty(n, dtype=np.int8), np.empty(n, dtype=bool)
    places = [tables[: s.nodes], tables[s.nodes : s.nodes + s.slots], tables[s.nodes + s.slots :]]
    for a in range(0, n, BLOCK):
        on = slice(a, a + BLOCK)
        flat, *keys = (x[on] if order is None else x.take(order[on], mode="wrap") for x in (s.flat, s.key1, s.key2))
        # every place is in its table; with mode wrap, take has no more to do than to look it up
        found = [table.take((key >> np.uint32(1)).astype(np.intp), mode="wrap") for table, key in zip(places, (flat, *keys), strict=True)]
        for k, v in enumerate(found):
            np.multiply(v, np.float32(1 / 1024), out=odds[k, on], casting="unsafe")
        gate[on] = (found[1] & 3) * 4 + (found[2] & 3) + (flat >= np.uint32(2 * s.spelled)).view(np.int8) * np.int8(16)
        bit[on] = flat & np.uint32(1)
    return odds, gate, bit


def _tuning_inputs(sent, name: str):
    """Of each bit of the texts: log odds of the three predictors, and gate * 2 + bit."""

    def run(frames):
        codes, tables = sent.value, mapped(name) if name else None
        for _, texts in _slices(frames, []):
            s = Series(codes, texts)
            odds, gate, bit = _inputs(tables, s)
            yield pa.RecordBatch.from_pydict({"odds": pa.array([(odds * 1024).astype("<i2").tobytes()], pa.binary()), "gate": pa.array([(gate * 2 + bit).astype(np.uint8).tobytes()], pa.binary())})

    return run


PLAIN = np.array([0.4, 0.4, 0.3, 0.0])


def fit_weights(odds: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Gated weights of the predictors and a bias, by Newton's method per gate, drawn to a plain mean by PRIOR bits. odds: 3 x bits, in
    1/1024."""
    plain = PLAIN
    out = np.tile(plain, (GATES, 1))
    for g in range(GATES):
        on = np.flatnonzero(gate == g)
        if len(on) < 50:
            continue
        x = np.concatenate((odds[:, on] * np.float32(1 / 1024), np.ones((1, len(on)), dtype=np.float32)))
        y, w = bit[on], plain.copy()
        for _ in range(8):
            p = 1 / (1 + np.exp(-(w @ x)))
            grad = x @ (y - p) - PRIOR / 4 * (w - plain)
            step = np.linalg.solve((x * (p * (1 - p))) @ x.T + PRIOR / 4 * np.eye(4), grad)
            w = w + np.clip(step, -0.5, 0.5)
            if np.abs(step).max() < 1e-4:
                break
        out[g] = w
    return out


def newton_sums(odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each gate: gradient (4) and curvature (16) of the bits' log likelihood at these weights, their loss in nats and number."""
    out = np.zeros((GATES, 22))
    order = np.argsort(gate, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(gate, minlength=GATES))))
    x, other = np.ones((4, len(gate)), dtype=np.float32), (np.float32(1) - np.float32(2) * bit).take(order, mode="wrap")  # -1 where the bit is set
    for k in range(3):
        odds[k].take(order, out=x[k], mode="wrap")
    w = weights.astype(np.float32)
    for g in np.flatnonzero(np.diff(edge)).tolist():
        own, sign = x[:, edge[g] : edge[g + 1]], other[edge[g] : edge[g + 1]]
        z = w[g] @ own
        z *= sign
        np.exp(z.clip(-30, 30, out=z), out=z)  # odds of the other bit
        both = np.float32(1) + z
        z /= both
        lost = np.log(both, out=both).sum(dtype=np.float64)
        np.multiply(z, np.float32(1) - z, out=both)
        z *= sign
        out[g, :4] = -(own @ z)
        out[g, 4:20] = ((own * both) @ own.T).reshape(-1)
        out[g, 20:] = lost, len(sign)
    return out


def newton_step(weights: np.ndarray, sums: np.ndarray) -> float:
    """Moves the weights by one step of Newton's method per gate, drawn to a plain mean as in fit_weights; the share of the loss that the
    step promises."""
    gain = 0.0
    for g in np.flatnonzero(sums[:, 21]):
        grad = sums[g, :4] - PRIOR / 4 * (weights[g] - PLAIN)
        step = np.clip(np.linalg.solve(sums[g, 4:20].reshape(4, 4) + PRIOR / 4 * np.eye(4), grad), -0.5, 0.5)
        weights[g] += step
        gain += float(grad @ step) / 2
    return gain / max(1e-9, float(sums[:, 20].sum()))


def _fit_sums(sent, name: str, weights: np.ndarray):
    """One row a task: newton_sums of its texts."""

    def run(frames):
        codes, tables = sent.value, mapped(name) if name else None
        total = np.zeros((GATES, 22))
        for _, texts in _slices(frames, []):
            s = Series(codes, texts)
            total += newton_sums(*_inputs(tables, s), weights)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    return run


def refine(weights: np.ndarray, halves: list[tuple[DataFrame, str]], sent) -> list[tuple[float, int]]:
    """Newton steps over all texts of halves: (texts, name of the tables without them). Changes the weights; of each step the share of the
    loss that it promised and the number of bits read."""
    told = []
    while len(told) < STEPS and (not told or told[-1][0] > GAIN):
        sums = np.zeros((GATES, 22))
        for texts, name in halves:
            for row in texts.select("text").mapInArrow(_fit_sums(sent, name, weights.copy()), "sums binary").toArrow().column("sums"):
                sums += np.frombuffer(row.as_py(), dtype="<f8").reshape(GATES, 22)
        told.append((newton_step(weights, sums), int(sums[:, 21].sum())))
    return told


def bits_of(odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]], texts: int, weights: np.ndarray) -> np.ndarray:
    """Total bits of each text, read a segment at a time; each starts with the gated weights and no terms of its own.

    odds, gate and bit are in the order of by_segments: the same segment of all texts is read in one go, each with its text's terms, so
    short segments cost no more than long ones.
    """
    w = np.ascontiguousarray(weights.T, dtype=np.float32)
    own, seen = np.zeros((3, texts), dtype=np.float32), np.full((3, texts), PRIOR, dtype=np.float32)
    bias, met = np.zeros(texts * GATES, dtype=np.float32), np.full(texts * GATES, PRIOR)
    out, a = np.zeros(texts), 0
    for turn, (on, long) in enumerate(steps):
        b = a + int(long.sum())
        first = np.cumsum(long) - long
        x, g, text = odds[:, a:b], gate[a:b].astype(np.intp), np.repeat(on, long)
        s = np.float32(2) * bit[a:b] - np.float32(1)
        z = w[3].take(g, mode="wrap")
        for k in range(3):
            u = w[k].take(g, mode="wrap")
            if turn:
                u += own[k].take(text, mode="wrap")
            u *= x[k]
            z += u
        text *= GATES
        g += text
        if turn:
            z += bias.take(g, mode="wrap")
        z *= s
        np.exp(z.clip(-15, 30, out=z), out=z)
        z += np.float32(1)
        wrong = np.reciprocal(z, out=z)  # probability of the other bit
        right = np.float32(1) - wrong
        out[on] -= np.add.reduceat(np.log(right), first, dtype=np.float64)
        if turn + 1 < len(steps):  # what the last segment would teach, nobody reads
            right *= wrong
            wrong *= s
            for k in range(3):
                np.multiply(x[k], right, out=u)
                u *= x[k]
                seen[k, on] += np.add.reduceat(u, first)
                own[k, on] += np.add.reduceat(np.multiply(x[k], wrong, out=u), first) / seen[k, on]
            met += np.bincount(g, right, len(met))
            bias += np.bincount(g, wrong, len(met)) / met
        a = b
    return out / math.log(2)


@functools.cache
def keep_freed() -> None:
    """This process takes its next arrays from memory that it has freed, up to KEPT bytes, rather than fresh pages from the system each
    time, where its C library can be told so."""
    with suppress(OSError, AttributeError):
        told = ctypes.CDLL(None).mallopt
        told(-3, 1 << 25)  # M_MMAP_THRESHOLD, the most it takes
        told(-1, KEPT)  # M_TRIM_THRESHOLD


def _slices(frames, columns: list[str]):
    """(columns as lists, folded texts) with about SLICE_BYTES of text together."""
    keep_freed()
    for frame in frames:
        values = [frame.column(c).to_pylist() for c in columns]
        texts = frame.column("text")
        low, part, size = 0, [], 0
        for k in range(frame.num_rows):
            part.append(folded(texts[k].as_py()))
            size += len(part[-1]) + 8
            if size >= SLICE_BYTES or k == frame.num_rows - 1:
                yield [v[low : k + 1] for v in values], part
                low, part, size = k + 1, [], 0


def _word_array(texts: list[bytes]) -> pa.Array:
    """All words of the texts in turn, made from their bytes without an object a word."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = IN_WORD.take(buf)
    last = np.flatnonzero(inside[1:] < inside[:-1])
    ends = np.concatenate(([0], np.cumsum(inside, dtype=np.int32).take(last))).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(ends), pa.py_buffer(buf[inside])])


def _words(frames):
    """Counts of words, and of the end under its own name (no word has a line break in it)."""
    held, counted, ends = [], [], 0

    def count():
        found = pa.chunked_array(held, pa.binary()).value_counts()
        counted.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
        held.clear()

    def out():
        ended = pa.table([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])
        sums = pa.concat_tables([*counted, ended]).group_by("word", use_threads=False).aggregate([("n", "sum")])
        counted.clear()
        return sums.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    for _, texts in _slices(frames, []):
        held.append(_word_array(texts))
        ends += len(texts)
        if len(held) == COUNTED_SLICES:
            count()
            if sum(t.num_rows for t in counted) > COUNTED_WORDS:
                yield from out()
                ends = 0
    if held:
        count()
    if ends:
        yield from out()


def _gaps(place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places in bytes: each the steps from the one before (from -1 where a range begins), 255 being so many steps and no
    place; and of each place the byte after its last."""
    gap = np.diff(place, prepend=-1)
    gap[first] = place[first] + 1
    far = gap // 255
    end = np.cumsum(far + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 255, dtype=np.uint8)
    out[end - 1] = gap - 255 * far
    return out, end


def _sorted_rows(keys: np.ndarray, base: int) -> pa.RecordBatch:
    """Rows of the counts of keys slot * 2 + bit, range by range from base on."""
    keys.sort()
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    found, times = keys[edge].astype(np.int64), np.diff(np.append(edge, len(keys)))
    of = found // (2 * RANGE)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    at, end = _gaps(found - of * (2 * RANGE), first)
    cut = np.append(first, len(found))
    large = np.flatnonzero(times >= 255)
    more = [b""] * len(first)
    many = np.searchsorted(large, cut)
    for k in np.flatnonzero(np.diff(many)).tolist():
        own = large[many[k] : many[k + 1]]
        more[k] = _more(own - cut[k], times[own])
    of_bytes = lambda cuts, data: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(of[first] + base, pa.int64()), of_bytes(np.concatenate(([0], end))[cut], at), of_bytes(cut, np.minimum(times, 255).astype(np.uint8)), pa.array(more, pa.binary())], COLUMNS)


def _more(large: np.ndarray, n: np.ndarray) -> bytes:
    return np.concatenate((large, np.minimum(n, 2**32 - 1))).astype("<u4").tobytes()


def _row(k: int, n: np.ndarray) -> tuple:
    """Range, places as _gaps has them (null: all), their counts in a byte each (compressed where all are there), and where these are too
    large: at which of them, then the counts. n: of each place, slot * 2 + bit."""
    at = None
    if 16 * np.count_nonzero(n) < len(n):
        some = np.flatnonzero(n)
        at, n = _gaps(some, some[:0])[0].tobytes(), n[some]
    large = np.flatnonzero(n >= 255)
    data = np.minimum(n, 255).astype(np.uint8).tobytes()
    return k, at, data if at is not None else pa.compress(data, "zstd", asbytes=True), _more(large, n[large])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], COLUMNS)


def read_counts(at: bytes | None, n: bytes, more: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places and counts of such a row."""
    if at is None:
        n = pa.decompress(n, 2 * RANGE, "zstd")
    counts = np.frombuffer(n, dtype=np.uint8).astype(np.int64)
    large, values = np.frombuffer(more, dtype="<u4").reshape(2, -1)
    counts[large] = values
    if at is None:
        return slice(None), counts
    steps = np.frombuffer(at, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255] - 1, counts


def _counts(sent):
    def run(frames):
        codes = sent.value
        dense = codes.slot_bits <= DENSE_BITS
        bounds = [0, codes.nodes, codes.nodes + codes.slots, codes.nodes + 2 * codes.slots]
        n = np.zeros(2 * (bounds[3] if dense else codes.nodes), dtype=np.uint32)  # place * 2 + bit
        symbols = np.zeros(len(codes.length), dtype=np.int64)
        kept: list[tuple[np.ndarray, ...]] = []
        held, added, one = 0, 0, np.uint32(1)

        def add():
            for k in (1, 2):
                keys = np.concatenate([x[k - 1] for x in kept])
                if dense:
                    keys.sort()  # sorting costs less than what it spares: places far apart are not in the processor's cache
                    np.add.at(n[2 * bounds[k] : 2 * bounds[k + 1]], keys, one)
                else:
                    yield _sorted_rows(keys, bounds[k] // RANGE)

        def told():
            # a symbol's bits are those of its code, so the plain nodes are counted from the symbols
            some, depth = np.flatnonzero(symbols), 0
            while len(some := some[codes.length[some] > depth]):
                np.add.at(n, codes.steps[codes.offset[some] + depth].astype(np.uint32), symbols[some].astype(np.uint32))
                depth += 1
            for low in range(0, len(n) // 2, RANGE):
                part = n[2 * low : 2 * (low + RANGE)]
                if part.any():
                    yield _batch([_row(low // RANGE, part)])

        for _, texts in _slices(frames, []):
            s = Series(codes, texts)
            symbols += np.bincount(s.sym, minlength=len(symbols))
            kept.append((s.key1, s.key2))
            held += len(s.flat)
            if held >= (HELD if dense else SORTED):
                yield from add()
                kept.clear()
                held, added = 0, added + held
                if added >= 1 << 31:  # before a count can leave 32 bits
                    yield from told()
                    n[:] = symbols[:] = added = 0
        if kept:
            yield from add()
        yield from told()

    return run


COUNTED, COLUMNS = "range long, at binary, n binary, more binary", ["range", "at", "n", "more"]


def _summed(frames):
    """One row a range from rows that are sorted by range."""
    now, total = None, np.zeros(RANGE * 2, dtype=np.int64)
    for frame in frames:
        done = []
        for k, *row in zip(*(frame.column(c).to_pylist() for c in COLUMNS), strict=True):
            if k != now:
                if now is not None:
                    done.append(_row(now, total))
                now, total[:] = k, 0
            at, n = read_counts(*row)
            total[at] += n
        if done:
            yield _batch(done)
    if now is not None:
        yield _batch([_row(now, total)])


@contextmanager
def _for_once(spark, **conf: str):
    """Settings of the session that hold inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settled(df: DataFrame, tag: str) -> DataFrame:
    """materialize; what it shuffled leaves the disks as soon as it is written, not when the driver happens to collect its garbage."""
    with _for_once(df.sparkSession, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}):
        return materialize(df, tag)


def sum_counts(parts: DataFrame) -> DataFrame:
    """One row a range of slots."""
    return settled(parts.repartition("range").sortWithinPartitions("range").mapInArrow(_summed, COUNTED), "tables")


def count_ranges(train: DataFrame, sent, rounds: int = 1) -> DataFrame:
    """Counts of the three predictors from the texts of train (doc_id, text), a row a range, of so many parts one after another."""
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(rounds))
    parts = [sum_counts(train.filter(part == k).select("text").mapInArrow(_counts(sent), COUNTED)) for k in range(rounds)]
    if rounds == 1:
        return parts[0]
    whole = sum_counts(functools.reduce(DataFrame.union, parts))
    release(*parts)
    return whole


def _packed_ranges(frames):
    for frame in frames:
        out = []
        for row in zip(frame["at"], frame["n"], frame["more"], strict=True):
            n = np.zeros(RANGE * 2, dtype=np.int64)
            at, found = read_counts(*row)
            n[at] = found
            out.append(packed(n[::2], n[1::2]).astype("<i2").tobytes())
        yield pd.DataFrame({"range": frame["range"], "odds": out})


def send_tables(ranges: DataFrame, codes: Codes) -> str:
    """Name of the file with the predictors' tables that all executors get. It passes the driver a range at a time."""
    folder, name = tempfile.mkdtemp(prefix="quarry-tables-"), f"tables-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)
    out = np.memmap(os.path.join(folder, name), dtype="<i2", mode="w+", shape=codes.nodes + 2 * codes.slots)  # 0 where nothing is counted
    for r in ranges.mapInPandas(_packed_ranges, "range long, odds binary").toLocalIterator():
        out[r["range"] * RANGE : (r["range"] + 1) * RANGE] = np.frombuffer(r["odds"], dtype="<i2")
    out.flush()
    del out
    ranges.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    _sent[name] = folder
    return name


def drop_tables(name: str) -> None:
    """Tables that nothing reads any more leave the driver's disk; an executor that joins later fetches an empty file in their place."""
    os.truncate(os.path.join(_sent.pop(name), name), 0)
    drop_copy(name)


def drop_copy(name: str) -> None:
    """This process's executor (or driver) needs its copy of the tables no more."""
    with suppress(FileNotFoundError):
        os.remove(SparkFiles.get(name))


#: Folder of each file of tables that the driver has sent.
_sent: dict[str, str] = {}


def mapped(name: str) -> np.ndarray:
    """The tables, read from the file where they are looked up."""
    return np.asarray(np.memmap(SparkFiles.get(name), dtype="<i2", mode="r"))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, bits double, n_bytes long, rare array<binary>"


def _scores(sent, name: str | None, stale: list[str], weights: np.ndarray | None, divisor: float, n_end: int):
    def run(frames):
        for old in stale:
            drop_copy(old)
        codes, tables = sent.value, mapped(name) if name else None
        logs = np.log10(codes.counts + 0.5)
        row = TaskContext.get().partitionId() << 33
        # texts of like length are read together, so that few segments are read alone
        alike = (frame.take(pc.sort_indices(pc.fill_null(pc.binary_length(frame.column("text")), 0))) for frame in frames)
        for (ids, held), texts in _slices(alike, ["doc_id", "held_out"]):
            s = Series(codes, texts)
            bits = np.zeros(len(texts))
            if name:
                order, steps = by_segments(s.start, s.bits)
                bits = bits_of(*_inputs(tables, s, order), steps, len(texts), weights)
            owner = np.repeat(np.arange(len(texts)), s.n_words)
            common = s.rank >= 0
            base = np.bincount(owner[common], weights=logs[s.rank[common]], minlength=len(texts)) + math.log10(n_end + 0.5)
            known = np.bincount(owner[common], minlength=len(texts)) + (n_end > 0)
            base -= (np.bincount(owner[common], minlength=len(texts)) + 1) * math.log10(divisor)
            rare: list[list[bytes]] = [[] for _ in texts]
            for i, w in zip(owner[s.rare].tolist(), s.rare_words, strict=True):
                rare[i].append(w)
            values = {
                "row": pa.array(range(row, row + len(texts)), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(s.n_words + 1, pa.int64()), "known": pa.array(known, pa.int64()), "base": pa.array(base, pa.float64()), "bits": pa.array(bits, pa.float64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "rare": pa.array(rare, pa.list_(pa.binary())),
            }
            row += len(texts)
            yield pa.RecordBatch.from_pydict(values)

    return run


def _fitted(train: DataFrame, sent, codes: Codes, n_end: int) -> tuple[np.ndarray, str, list[str]]:
    """Weights, name of the tables of all training texts, and names of tables that nothing reads any more."""
    slot_bits = codes.slot_bits
    # a first fit on texts that the tables don't count yet; then steps over all, each half read with the tables of the other
    share = min(1 / TUNING_SHARE, max(TUNING_TEXTS, n_end**0.5) / max(1, n_end))
    tuning = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 40)) < int(share * (1 << 40))
    half = F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(2))
    rounds = 1 if slot_bits <= DENSE_BITS else ROUNDS // 2
    tuned = materialize(train.filter(tuning).select("doc_id", "text"), "tuning")
    counted = [count_ranges(train.filter(~tuning & (half == k)), sent, rounds) for k in range(2)]
    others = sum_counts(counted[0].union(counted[1]))
    weights = np.tile(PLAIN, (GATES, 1))
    name = send_tables(others, codes)
    drawn = tuned.orderBy(F.xxhash64("doc_id"), "text").limit(int(2 * share * n_end) + 1).select("text")  # ids that repeat may draw many
    inputs = drawn.mapInArrow(_tuning_inputs(sent, name), "odds binary, gate binary").toArrow()
    both, stale = others, []
    if inputs.num_rows:
        odds = np.concatenate([np.frombuffer(x.as_py(), dtype="<i2").reshape(3, -1) for x in inputs.column("odds")], axis=1)
        marks = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint8) for x in inputs.column("gate")])
        weights = fit_weights(odds, (marks >> 1).astype(np.int8), (marks & 1).astype(bool))
        del inputs, odds, marks
        few = count_ranges(tuned, sent)
        both = sum_counts(others.union(few))
        release(few)
    if n_end:
        apart = ((tuning | (half == 1), counted[0]), (~tuning & (half == 0), counted[1]))
        halves = [(train.filter(of), send_tables(without, codes)) for of, without in apart]
        refine(weights, halves, sent)
        stale = [half_name for _, half_name in halves]
    if both is not others:
        stale.append(name)
        name = None
    for old in stale:
        drop_tables(old)
    name = name or send_tables(both, codes)
    release(tuned, others, both, *counted)
    return weights.astype(np.float32), name, stale


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mixed: bool = True) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1; held_out is that remainder being 1. A null doc_id teaches nothing
    and isn't held out. A null text counts as empty: one token, the end. A very long text is read whole, by itself. Words of equal
    count are coded in the order of their bytes. Without training rows all counts are 0. Rows that repeat a doc_id are scored each. An
    empty table gives no rows. Other columns are ignored. Without mixed the last two columns, which alone need the tables, are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    if not mixed:
        small_batches(spark)
    left = F.crc32(F.col(id_col).cast("string")) % 5
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(left == 1, F.lit(False)).alias("held_out"), F.coalesce(left != 1, F.lit(False)).alias("train"))
    train = rows.filter("train")
    counts = settled(train.select("text").mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_end = (counts.filter(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0]) or 0
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the least count of frequent words comes from a histogram of counts, so no task gathers candidates from all others
    coded = counts.filter((F.col("word") != F.lit(END)) & (F.octet_length("word") <= WORD_BYTES)).withColumn("size", F.floor(F.log2("n") * 16))
    slot_bits = min(MOST_BITS, max(SLOT_BITS, int(total // TOKENS_A_SLOT).bit_length()))
    coded_most = coded_words(slot_bits)
    least, room = None, FREQUENT * coded_most // CODED
    for r in sorted(coded.groupBy("size").agg(F.count("*").alias("words")).collect(), reverse=True):
        if r["words"] > room:
            break
        least, room = r["size"], room - r["words"]
    top = coded.filter(F.col("size") >= least if least is not None else F.lit(False)).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, found = top.column("word").to_pylist(), top.column("n").to_pylist()
    codes = Codes(words, found, total - n_end - sum(found[:coded_most]), n_end, slot_bits)
    del top, words, found
    sent = spark.sparkContext.broadcast(codes)
    weights, name, stale = _fitted(train, sent, codes, n_end) if mixed else (None, None, [])
    divisor = total + 0.5 * (kinds + 1)
    scored = materialize(rows.select("doc_id", "text", "held_out").mapInArrow(_scores(sent, name, stale, weights, divisor, n_end), SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / divisor)).alias("more"), F.count("n").alias("also"))
    out = scored.drop("rare").join(rare, "row", "left")
    base = ["doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score")]
    mix_score = [(-F.col("bits") * math.log10(2)).alias("score"), (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")]
    return out.select(*base, *(mix_score if mixed else []))
