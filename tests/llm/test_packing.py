import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.tokens import SPECIAL, default_paths


def test_fullest_equals_all_subsets():
    draw = random.Random(1)
    for _ in range(200):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(0, 8))]
        room = draw.randint(0, 25)
        counts = {x: lengths.count(x) for x in lengths}
        best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= room)
        got = packing.fullest(counts, room)
        assert sum(x * k for x, k in got) == best and all(k <= counts[x] for x, k in got)


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(default_paths()[0])


def test_round_trip(spark, docs_of, slow):
    draw = random.Random(3)
    texts = [None, "", " ", f"a {SPECIAL} b", f"{SPECIAL}{SPECIAL}\n {SPECIAL}x", "<|endoftext", "é😀\x00 ünï", "x" * 5000]
    texts += [" ".join("".join(draw.choice("etaoin ##1'\n") for _ in range(draw.randint(1, 9))) for _ in range(draw.choice([1, 50, 300, 2500]))) for _ in range(150)]
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    docs = docs_of(rows)
    got = packing.pack(docs, window_docs=50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(docs_of(rows[::-1]), window_docs=50).collect()))
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = padded = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 1024 - at)
    assert padded < 0.03 * total


def test_repeated_rows_and_empty_table(spark, docs_of):
    assert len(packing.pack(docs_of([(1, "a", "", ""), (1, "a", "", ""), (None, "b", "", "")])).collect()) == 3
    assert packing.pack(docs_of([])).count() == 0


def test_a_special_name_is_one_id(slow):
    from quarry.llm.tokens import encoder

    assert encoder(default_paths()).ids(f"a {SPECIAL} b") == slow.encode(f"a {SPECIAL} b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_repeated_rows_spread_over_windows(spark, docs_of):
    """One row half of the table: no window holds much more than its share, and long texts' pieces are dealt out too."""
    rows = [(7, "the same words again", "", "")] * 300 + [(i, f"text number {i}", "", "") for i in range(100, 400)] + [(5000, "word " * 9000, "", "")]
    got = packing.pack(docs_of(rows), window_docs=50).collect()
    held = Counter(r.sequence_id >> 40 for r in got)
    assert len(held) == 13 and max(held.values()) <= 120
    assert len({r.sequence_id for r in got if r.length == 1024}) == sum(r.length == 1024 for r in got) == 8
