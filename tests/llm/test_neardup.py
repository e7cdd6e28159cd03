import random
import re

import numpy as np

from quarry.llm import neardup, shingles, trie

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    found = [(i, sets(t)) for i, t, *_ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(found):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(s), least[root(k)]) for k, (i, s) in enumerate(found))


def corpus(draw, n):
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 9, 40, 80, 200]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(draw.choice(bases[: 3 if i % 3 == 0 else None]))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary).upper()
        if draw.random() < 0.3:
            words += passage
        rows.append((i * 7 % 1009, " ".join(words), "en", "s"))
    return rows + [(5000, None, "", ""), (5001, "", "", ""), (5002, " \n", "", ""), (5003, "a b", "", ""), (5004, "A  b", "", ""), (5005, " x ", "", "")]


def test_equals_brute_force(spark, docs_of):
    rows = corpus(random.Random(11), 400)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.jaccard_classes(docs_of(rows)).collect())
    assert got == brute(rows)


def test_many_blocks_and_hot_tokens(spark, docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "FIRST_TOKENS", 500)
    monkeypatch.setattr(neardup, "BLOCK_TOKENS", 1500)
    monkeypatch.setattr(neardup, "HOT_LEAST", 5)
    rows = corpus(random.Random(12), 300)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.jaccard_classes(docs_of(rows)).collect())
    assert got == brute(rows)


def test_trie_join_equals_all_pairs():
    draw = random.Random(4)
    for _ in range(30):
        base = [draw.sample(range(80), draw.randint(1, 30)) for _ in range(4)]
        raw = [set(draw.choice(base)) ^ set(draw.sample(range(80), draw.randint(0, 3))) for _ in range(25)]
        got = trie.similar_groups([np.array(sorted(s), dtype=np.uint64) for s in raw])
        want = trie.Groups(25)
        for a in range(25):
            for b in range(a):
                if raw[a] and raw[b] and 4 * len(raw[a] & raw[b]) >= 3 * len(raw[a] | raw[b]):
                    want.join(a, b)
        assert [got.find(i) for i in range(25)] == [want.find(i) for i in range(25)]


def test_sets_are_counted_like_python_sets():
    draw = random.Random(6)
    texts = ["".join(draw.choice("ab \n\té\x0b ") for _ in range(draw.choice([0, 4, 30, 300]))) for _ in range(60)]
    got = shingles.shingle_sets([shingles.folded(t) for t in texts])
    assert [len(s) for s in got] == [len(sets(t)) for t in texts]


def test_repeated_rows_and_empty_table(spark, docs_of):
    long = " ".join(f"a{i}" for i in range(30))
    got = neardup.jaccard_classes(docs_of([(3, long, "", ""), (3, long, "", ""), (9, long + " b", "", "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 26, 3), (3, 26, 3), (9, 27, 3)]
    assert neardup.jaccard_classes(docs_of([])).count() == 0
    assert [r.doc_id for r in neardup.drop_near_copies(docs_of([(3, long, "", ""), (9, long + " b", "", ""), (4, None, "", "")])).collect()] == [3, 4]


def test_one_row_of_each_component_stays(spark, docs_of):
    """Ids that repeat under several texts, repeated rows and null ids: rows stay or go by their own text."""
    draw = random.Random(8)
    rows = [(draw.choice([None, *range(30)]), t, la, so) for _, t, la, so in corpus(draw, 200)]
    rows += rows[:20] + [(3, None, "", ""), (3, "", "", ""), (3, "", "", "")]
    place = brute([(k, t) for k, (_, t, *_) in enumerate(rows)])
    groups = {}
    for k, n, c in place:
        groups.setdefault(c if n else ("none", k), []).append(rows[k])
    got = neardup.drop_near_copies(docs_of(rows)).collect()
    low = lambda i: (i is None, i or 0)
    least = {}
    for c, members in groups.items():
        least[c] = min(low(i) for i, *_ in members)
    of_text = {rows[k][1]: c for k, n, c in place if n}
    kept = [(of_text[r.text], low(r.doc_id)) for r in got if r.text in of_text]
    assert sorted(kept) == sorted((c, i) for c, i in least.items() if not isinstance(c, tuple))
    assert sum(r.text not in of_text for r in got) == sum(isinstance(c, tuple) for c in groups)
    classes = {(r.doc_id, r.component_id) for r in neardup.jaccard_classes(docs_of(rows)).collect()}
    assert classes == {(i, least[c][1] if not least[c][0] else None) if not isinstance(c, tuple) else (i, i) for c, members in groups.items() for i, *_ in members}
