import hashlib
import random

from quarry.llm import dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_small_blocks_equal_brute_force(spark, docs_of):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abAB É") for _ in range(draw.choice([0, 1, 5, 16, 17, 40, 64, 65]))) for _ in range(40)]
    rows = [(i, draw.choice(texts), "en", "s") for i in range(200)] + [(900, None, None, None), (901, "", None, None)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.exact_dedup(docs_of(rows), block_bytes=8).collect()}
    assert got == brute(rows)


def test_order_of_blocks_matters_and_only_ascii_is_folded(spark, docs_of):
    rows = [(1, "aaaabbbbcccc", "", ""), (2, "bbbbaaaacccc", "", ""), (3, "ccccaaaabbbb", "", ""), (4, "É", "", ""), (5, "é", "", ""), (6, "AAAAbbbbCCCC", "", "")]
    got = {r.doc_id: r.keep_id for r in dedup.exact_dedup(docs_of(rows), block_bytes=4).collect()}
    assert got == {1: 6, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}


def test_repeated_rows_keep_one(spark, docs_of):
    long = "xyz" * 5
    got = dedup.exact_dedup(docs_of([(1, "a", "", ""), (1, "a", "", ""), (2, long, "", ""), (2, long, "", "")]), block_bytes=4).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 2, False), (1, 2, True), (2, 2, False), (2, 2, True)]


def test_empty_table(spark, docs_of):
    assert dedup.exact_dedup(docs_of([])).count() == 0
    assert dedup.drop_copies(docs_of([])).count() == 0


def test_drop_copies_keeps_rows_not_ids(spark, docs_of):
    """Repeated ids, repeated rows, one id under two texts, null ids: of each group of equal texts one row stays, that of the largest id."""
    draw = random.Random(5)
    texts = ["same text", "SAME text", "third", "THIRD", "é", "É", "", None, "x" * 40, "X" * 40]
    rows = [(1, "same text", "", ""), (1, "same text", "", ""), (5, "third", "", ""), (9, "THIRD", "", ""), (5, "alone", "", "")]
    rows += [(draw.choice([None, *range(12)]), draw.choice(texts), "", "") for _ in range(120)]
    got = dedup.drop_copies(docs_of(rows), block_bytes=8).collect()
    best = {}
    for i, t, *_ in rows:
        key = (t or "").translate(UP)
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    assert sorted(((r.text or "").translate(UP), -1 if r.doc_id is None else r.doc_id) for r in got) == sorted(best.items())
    assert all((r.doc_id, r.text) in {(i, t) for i, t, *_ in rows} for r in got)
