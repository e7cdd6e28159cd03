import math
import random
import zlib
from collections import Counter

import numpy as np

from quarry.llm import langid


def one_by_one(text):
    """Columns of a text's n-grams, one n-gram at a time."""
    out, mask = Counter(), (1 << 64) - 1
    points = [ord(c) + 1 for c in text.lower()]
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            x = sum(points[i + k] * int(langid.STEP[k]) for k in range(n)) & mask
            x = x * 0xD6E8FEB86659FD93 & mask
            x ^= x >> 32
            out[(x * (0xD6E8FEB86659FD93 + 2 * n) & mask) >> (64 - langid.BITS)] += 1
    return out


def test_scores_equal_brute_force(monkeypatch):
    draw = random.Random(1)
    logs = np.random.default_rng(2).normal(size=(3, 1 << langid.BITS)).astype(np.float32)
    texts = [None, "", "É", "ab"] + ["".join(draw.choice("abcÉ 😀\n") for _ in range(draw.randint(0, 60))) for _ in range(30)]
    for most in (1 << 18, 20, 3):
        monkeypatch.setattr(langid, "SLICE_CHARS", most)
        got = langid.score_texts(texts, logs)
        for t, row in zip(texts, got, strict=True):
            for k in range(3):
                assert math.isclose(row[k], sum(n * float(logs[k][c]) for c, n in one_by_one(t or "").items()), rel_tol=1e-6, abs_tol=1e-6)


def test_held_out_accuracy_and_contract(spark, docs_of):
    draw = random.Random(4)
    words = {"aa": ["haus", "über", "straße", "und"], "bb": ["maison", "été", "où", "et"], "cc": ["house", "over", "street", "and"]}
    rows = []
    for i in range(300):
        lang = draw.choice(list(words))
        rows.append((i, " ".join(draw.choice(words[lang]) for _ in range(12)), lang if i % 10 else None, "s"))
    true = {i: next(k for k, w in words.items() if t.split()[0] in w) for i, t, *_ in rows}
    got = langid.identify(docs_of(rows + [(900, None, "aa", ""), (901, "12 !?", "bb", ""), (902, "", None, "")])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 303 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert all(by[i].lang_pred == true[i] for i in true)


def test_nothing_to_learn_from(spark, docs_of):
    assert langid.identify(docs_of([])).count() == 0
    assert [r.lang_pred for r in langid.identify(docs_of([(1, "abc", None, ""), (None, "abc", "aa", "")])).collect()] == ["und", "und"]


def test_fit_and_posterior_equal_brute_force(spark, docs_of):
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice({"aa": "abcé ", "bb": "bcdx ", "cc": "xyzé "}[la]) for _ in range(draw.randint(1, 12))), la if i % 6 else None, "") for i, la in ((i, draw.choice(["aa", "bb", "cc"])) for i in range(150))]
    counts, docs = {}, Counter()
    for i, t, la, _ in rows:
        if la and zlib.crc32(str(i).encode()) % 3 != 1:
            counts.setdefault(la, Counter()).update(one_by_one(t))
            docs[la] += 1
    size = {la: sum(c.values()) + langid.ALPHA * (1 << langid.BITS) for la, c in counts.items()}
    for r in langid.identify(docs_of(rows)).collect():
        t = rows[r.doc_id][1]
        if not any(map(str.isalpha, t)):
            continue
        logs = {la: math.log(docs[la] / sum(docs.values())) + sum(n * math.log((counts[la][c] + langid.ALPHA) / size[la]) for c, n in one_by_one(t).items()) for la in sorted(counts)}
        best = max(logs.values())
        shares = {la: math.exp(x - best) for la, x in logs.items()}
        assert math.isclose(r.score, shares[r.lang_pred] / sum(shares.values()), rel_tol=1e-4) and logs[r.lang_pred] > best - 1e-4


def test_every_language_is_learned_from_some_text(spark, docs_of, monkeypatch):
    """One very long text takes nearly all characters of the sample; its language and the others are learned all the same."""
    rows = [(i, "haus und straße", "aa", "") for i in range(20)] + [(50, "und haus " * 30_000, "aa", "")] + [(100 + i, "où été maison", "bb", "") for i in range(20)]
    got = langid.identify(docs_of(rows), sample_chars=1000).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id < 100 else "bb") for r in got)
