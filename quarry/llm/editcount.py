"""Token counts of edited texts, without encoding them anew.

The tokenizer encodes pre-tokens one by one, so a text's count is a sum over them. A segment tree over runs of pre-tokens keeps sums
of characters and tokens. From a pre-token's start on, the split depends on the text from there on only, and no match looks
further than the second character after its end. So an edit touches the pre-tokens that end less than two characters before it,
and those up to the first old boundary behind it at which a new pre-token ends too; only these are split and encoded again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .tokens import default_paths, encoder

RUN, MOST_IN_RUN, WINDOW, MOST_CACHED, CACHED_CHARS = 64, 1024, 64, 400_000, 64
#: What the query replaces: addresses, long hexadecimal strings and long numbers.
#: Each run is tried once, from its start and without going back, so that long runs cost no more than their length.
REDACT = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+|(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])|\d{6,}")
REDACTED = "[removed]"


class Counter:
    """Tokens of a pre-token; those of short ones are kept, MOST_CACHED at most."""

    def __init__(self, encode, split):
        self.encode, self.split, self.kept = encode, split, {}

    def __call__(self, piece: str) -> int:
        n = self.kept.get(piece)
        if n is None:
            n = len(self.encode(piece))
            if len(piece) <= CACHED_CHARS:
                if len(self.kept) >= MOST_CACHED:
                    self.kept.clear()
                self.kept[piece] = n
        return n


class CountTree:
    """A text's pre-tokens in runs, under a binary tree of (characters, tokens). A run is its text and its pieces' sizes and counts,
    so an edit copies the runs that it touches and nothing else."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        pieces = counter.split(text)
        kept = counter.kept
        counts = [kept[p] if p in kept else counter(p) for p in pieces]
        self._plant(_runs(text, list(map(len, pieces)), counts))
        self.pieces, self.encoded = len(pieces), 0

    def _plant(self, runs: list[tuple[str, list[int], list[int]]]) -> None:
        self.runs = runs or [("", [], [])]
        self.width = 1 << (len(self.runs) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (t, _, c) in enumerate(self.runs):
            self.chars[self.width + k], self.tokens[self.width + k] = len(t), sum(c)
        for k in range(self.width - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def total(self) -> int:
        return self.tokens[1]

    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(t for t, _, _ in self.runs)

    def _find(self, at: int) -> tuple[int, int]:
        """The run that holds character at, and where it starts; the last run if at is the end."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the text from start to stop by new."""
        run, at = self._find(max(0, start - 2))
        own, sizes, _ = self.runs[run]
        first, before = 0, 0
        while first < len(sizes) and at + sizes[first] < start - 1:
            at, before, first = at + sizes[first], before + sizes[first], first + 1
        # the text from there on, run by run, with the edit in it
        parts, have, last = [own[before:]], len(own) - before, run
        while at + have < stop and last + 1 < len(self.runs):
            last += 1
            parts.append(self.runs[last][0])
            have += len(parts[-1])
        tail = "".join(parts)
        behind = iter(range(last + 1, len(self.runs)))
        pieces = self._split(tail[: start - at] + new + tail[stop - at :], lambda: next((self.runs[k][0] for k in behind), None))
        grown = len(new) - (stop - start)
        # old boundaries from here on, while new pre-tokens are made one after another
        old_run, old_k, old_end = run, first, at
        made: list[str] = []
        where = at
        for piece in pieces:
            made.append(piece)
            where += len(piece)
            while old_end + grown < where or old_end < stop:
                sizes = self.runs[old_run][1]
                if old_k < len(sizes):
                    old_end += sizes[old_k]
                    old_k += 1
                elif old_run + 1 < len(self.runs):
                    old_run, old_k = old_run + 1, 0
                else:
                    break
            if old_end + grown == where and old_end >= stop:
                break
        else:  # the new text ended: nothing old is left behind it
            old_run, old_k = len(self.runs) - 1, len(self.runs[-1][1])
        self.encoded += len(made)
        text, sizes, counts = self.runs[old_run]
        rest = (text[sum(sizes[:old_k]) :], sizes[old_k:], counts[old_k:])
        text, sizes, counts = self.runs[run]
        now = (text[:before] + "".join(made), sizes[:first] + list(map(len, made)), counts[:first] + list(map(self.counter, made)))
        if old_run == run:
            now = tuple(a + b for a, b in zip(now, rest, strict=True))
        else:
            self.runs[old_run] = rest
        self.runs[run] = now
        for k in range(run + 1, old_run):
            self.runs[k] = ("", [], [])
        if len(now[1]) > MOST_IN_RUN:  # so many pieces came in that the whole tree is planted anew at a small cost for each
            self._plant([part for r in self.runs for part in _runs(*r)])
            return
        changed = set()
        for k in range(run, old_run + 1):
            self.chars[self.width + k], self.tokens[self.width + k] = len(self.runs[k][0]), sum(self.runs[k][2])
            changed.add((self.width + k) // 2)
        while changed and 0 not in changed:
            for k in changed:
                self._add(k)
            changed = {k // 2 for k in changed}

    def _split(self, text: str, more):
        """Pre-tokens of text and what more() adds, split from windows of it; those that could see a window's end wait for the next."""
        size, low, done = WINDOW, 0, False
        while True:
            while len(text) - low <= size and not done:
                part = more()
                done = part is None
                text, low = text[low:] + (part or ""), 0
            if low == len(text):
                return
            ended = done and len(text) - low <= size
            left = len(text) - low if ended else size - 3
            found = self.counter.split(text[low : low + size])
            for piece in found:
                left -= len(piece)
                if left < 0:
                    break
                yield piece
                low += len(piece)
            if not ended and found and len(found[0]) > size - 3:
                size *= 4


def _runs(text: str, sizes: list[int], counts: list[int]) -> list[tuple[str, list[int], list[int]]]:
    """Runs of RUN pieces."""
    out, at = [], 0
    for i in range(0, len(sizes), RUN):
        part = sizes[i : i + RUN]
        end = at + sum(part)
        out.append((text[at:end], part, counts[i : i + RUN]))
        at = end
    return out


def redactions(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), REDACTED) for m in REDACT.finditer(text)]


def counter(paths: tuple[str, str]) -> Counter:
    import regex

    one = encoder(paths)
    return Counter(one.ids, regex.compile(one.pattern).findall)


def _counts(paths: tuple[str, str], find):
    def run(frames):
        count = counter(paths)
        for frame in frames:
            rows = []
            for doc, text in zip(frame.column("doc_id").to_pylist(), frame.column("text"), strict=True):
                text = text.as_py() or ""
                edits = find(text)
                tree = CountTree(text, count)
                before, moved = tree.total(), 0
                for start, stop, new in edits:  # in order, not overlapping
                    tree.edit(start + moved, stop + moved, new)
                    moved += len(new) - (stop - start)
                rows.append((doc, before, tree.total(), len(edits), tree.pieces, tree.encoded, tree.length()))
            names = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_pieces", "n_encoded_again", "n_chars_edited"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})

    return run


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=redactions, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_tokens of the text, n_tokens_edited after the edits that find(text) gives, n_edits, n_pieces,
    n_encoded_again (pre-tokens that the edits made anew), n_chars_edited.

    find gives (start, stop, new) in order and without overlap. A null text counts as empty: 0 tokens. The special token's name in
    a text is ordinary text here. The work is linear in a text's length and in its edits, also for very long texts, of which one at a time is
    held. Rows that repeat a doc_id are counted each; an empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_pieces", "n_encoded_again", "n_chars_edited"]
    return rows.mapInArrow(_counts(paths or default_paths(), find), ", ".join(f"{n} long" for n in names))
