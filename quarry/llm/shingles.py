"""Sets of hashed word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
WORD_BYTE = np.where(IN_WORD, BYTE, np.uint64(0))
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base, have = 0x2545F4914F6CDD1D, [1]
        for _ in range(max(n, 256)):
            have.append(have[-1] * base & MASK)
        _powers = np.array(have, dtype=np.uint64)
    return _powers


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(FOLD)


def word_spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all parts in order: the bytes they lie in, their starts there, lengths and hashes; and each part's number."""
    buf = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = IN_WORD.take(buf)
    starts = np.flatnonzero(inside[1:] > inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate(([0], starts))
    limits = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    if not len(starts):
        return buf, starts, starts, np.empty(0, dtype=np.uint64), counts
    lengths = np.flatnonzero(inside[1:] < inside[:-1]) + 1 - starts
    # spaces add nothing, so each sum goes on to the next word; a place beyond the longest word is a space's
    place = np.arange(len(buf) - starts[0])
    place -= np.repeat(starts - starts[0], np.diff(starts, append=len(buf)))
    sums = powers(int(lengths.max())).take(place, mode="clip")
    sums *= WORD_BYTE.take(buf[starts[0] :])
    sums = np.add.reduceat(sums, starts - starts[0])
    return buf, starts, lengths, mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), counts


def shingle_sets(parts: list[bytes]) -> list[np.ndarray]:
    """Of each folded text: the sorted distinct hashes of its 5-word shingles, or of its words as one if there are fewer."""
    *_, words, counts = word_spans(parts)
    n = len(words) - WIDTH + 1
    rows = mix(sum(words[k : k + n] * PLACE[k] for k in range(WIDTH))) if n > 0 else np.empty(0, dtype=np.uint64)
    out, at = [], 0
    for k in counts.tolist():
        if k >= WIDTH:
            own = np.sort(rows[at : at + k - WIDTH + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif k:
            out.append(mix(np.array([int((words[at : at + k] * PLACE[:k]).sum())], dtype=np.uint64) + np.uint64(k)))
        else:
            out.append(words[:0])
        at += k
    return out


def fingerprint(own: np.ndarray) -> int:
    """Of a whole set, as a signed 64-bit integer."""
    a = int(mix(own ^ np.uint64(0xA0761D6478BD642F)).sum())
    x = np.array([(a + len(own) * 0xE7037ED1A0B428DB) & MASK], dtype=np.uint64)
    return int(mix(x).view(np.int64)[0])


def in_slices(texts, most: int = 1 << 20):
    """(position of the first, folded texts) of consecutive texts with about most bytes together."""
    part, size, first = [], 0, 0
    for k, text in enumerate(texts):
        part.append(folded(text))
        size += len(part[-1])
        if size >= most:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part
