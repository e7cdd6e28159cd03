import random
import time

import pytest

from quarry.llm import editcount
from quarry.llm.tokens import default_paths


@pytest.fixture(scope="module")
def count():
    return editcount.counter(default_paths())


def test_edits_equal_encoding_anew(count):
    draw = random.Random(7)
    parts = ["a", "bc", " ", "  ", "\n", "'", "'ll", "'s", "1", "23", "é", "!", "?!", "\t", "word ", "😀"]
    for n in (0, 1, 5, 40, 900, 3000):
        for _ in range(25 if n < 900 else 4):
            text = "".join(draw.choice(parts) for _ in range(n))
            tree = editcount.CountTree(text, count)
            assert tree.total() == len(count.encode(text))
            for _ in range(12):
                start = draw.randint(0, len(text))
                stop = min(len(text), start + draw.choice([0, 0, 1, 2, 9, 300]))
                new = "".join(draw.choice(parts) for _ in range(draw.choice([0, 0, 1, 3, 20])))
                tree.edit(start, stop, new)
                text = text[:start] + new + text[stop:]
                assert tree.text() == text and tree.length() == len(text) and tree.total() == len(count.encode(text)), (text, start, stop, new)
                assert [s for r in tree.runs for s in r[1]] == [len(p) for p in count.split(text)]


def test_crowded_runs_are_planted_anew(count, monkeypatch):
    monkeypatch.setattr(editcount, "MOST_IN_RUN", 80)
    draw = random.Random(2)
    text = "a b, c\n" * 100
    tree = editcount.CountTree(text, count)
    for _ in range(60):
        at, new = draw.randint(0, len(text)), "".join(draw.choice("xy z'1\n") for _ in range(draw.choice([1, 90, 2000])))
        tree.edit(at, at, new)
        text = text[:at] + new + text[at:]
        assert tree.text() == text and tree.total() == len(count.encode(text))
    assert max(len(r[1]) for r in tree.runs) <= 80


def test_many_edits_cost_in_proportion(count):
    """160,000 edits of a text of 2 MB take seconds: no edit copies the text."""
    line = "mail a@b.org 1234567 "
    text = line * 160_000
    tree, moved, size = editcount.CountTree(text, count), 0, len(line)
    began = time.process_time()
    for k in range(160_000):
        tree.edit(k * size + 5 + moved, k * size + 12 + moved, "[removed]")
        moved += 2
    assert time.process_time() - began < 40
    edited = "mail [removed] 1234567 " * 160_000
    assert tree.text() == edited and tree.total() == editcount.CountTree(edited, count).total()


def test_only_a_neighbourhood_is_encoded(count):
    tree = editcount.CountTree("some words " * 5000, count)
    tree.edit(25_000, 25_003, "XYZ")
    assert tree.encoded < 10


def test_query(spark, docs_of, count):
    texts = [None, "", "no edits here", "mail a.b@c.example.com now", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 1234567 x', "9" * 50_000 + " z" * 3000]
    got = {r.doc_id: r for r in editcount.edited_counts(docs_of([(i, t, "", "") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        edited = editcount.REDACT.sub(editcount.REDACTED, t or "")
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].n_chars_edited) == (len(count.encode(t or "")), len(count.encode(edited)), len(edited))
    assert [got[i].n_edits for i in range(6)] == [0, 0, 0, 1, 2, 1]
    assert editcount.edited_counts(docs_of([])).count() == 0
