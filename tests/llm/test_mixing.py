import random
import re

from quarry.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes):
    """Targets by the definition: share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(spark, docs_of):
    draw = random.Random(5)
    rows = [(i, " ".join("w" * draw.randint(1, 5) for _ in range(draw.choice([0, 3, 40, 300]))) if i % 50 else None, "en", draw.choice(["a", "b", "big", "big", "big", None, "é", "tiny" if i < 9 else "a"])) for i in range(900)]
    got = mixing.mix(docs_of(rows)).collect()
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    want = fill(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, (s, taken[s], want[s])
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs_of(rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_empty_and_wordless(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of([(1, None, None, None), (1, " ", None, "a")])).collect()] == [0, 0]
    assert mixing.mixed_documents(docs_of([(1, None, None, None)])).count() == 0


def test_sources_smaller_than_a_block(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 8)  # blocks of 4,096 words from 32,768 words on
    sizes = {"a": 20, "b": 60000, "c": 1000, "d": 5000, "e": 40000, None: 300}
    rows = []
    for s, n in sizes.items():
        for low in range(0, n, 100):
            rows.append((len(rows), " ".join(["w"] * min(100, n - low)), "en", s))
    want = fill(sizes)
    taken = {}
    for r in mixing.mix(docs_of(rows)).collect():
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes), (taken, want)
    kept = {r.source for r in mixing.mixed_documents(docs_of(rows)).select("source").distinct().collect()}
    assert kept == set(sizes)


def test_many_small_sources(spark, docs_of):
    """One source of most words beside 400 of 30 words and a null one: each ends within a word of its target."""
    rows = [(i, " ".join(["w"] * 1000), "en", "big") for i in range(400)] + [(1000 + 3 * k + j, " ".join(["w"] * 10), "en", f"s{k}") for k in range(400) for j in range(3)]
    rows += [(9000 + j, "a b c", "en", None) for j in range(5)]
    sizes, taken = {}, {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fill(sizes)
    for r in mixing.mix(docs_of(rows)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_documents_come_by_their_own_text(spark, docs_of):
    """One id under two texts, and repeated rows: the words of each text come as often as the mix takes its rows."""
    rows = [(1, "a b c d", "en", "x"), (1, "e f", "en", "x"), (2, "g h", "en", "x"), (2, "g h", "en", "x"), (2, "g h", "en", "y"), (None, "i j k", "en", "y"), (None, "l", "en", None)] + [(k, f"w{k} v u", "en", "z") for k in range(10, 60)]
    docs = docs_of(rows)
    size = lambda t: len(t.split())
    text_of = {r.h: r.text for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    want = {}
    for r in mixing._mixed(docs, "doc_id", "text", "source").collect():
        key = (r.doc_id, r.source, text_of[r.h1])
        want[key] = want.get(key, 0) + round(r.taken / size(key[2]))
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[(r.doc_id, r.source, r.text)] = got.get((r.doc_id, r.source, r.text), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
