import random
import zlib

import numpy as np

from quarry.llm import ranking
from quarry.llm.textstats import FEATURES, features, text_counts


def test_newton_finds_the_separating_direction():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(size=(300, 3)) + [1.5, 0, 0], draw.normal(size=(200, 3))
    w = ranking.fit_pairs(good, bad)
    assert w[0] > 1 and abs(w[1]) < 0.4 and abs(w[2]) < 0.4


def test_held_out_accuracy_and_contract(spark, docs_of):
    draw = random.Random(8)
    rows, marks = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 7))).upper()[: None if bad else 0] or "ordinary" + str(draw.randint(0, 99)) for _ in range(draw.randint(1, 90))]
        rows.append((i, " ".join(words), "", ""))
        marks.append((i, int(not bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = ranking.rank_quality(docs_of(rows + [(800, None, "", ""), (801, "", "", ""), (None, "x", "", "")]), labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 503 and by[800].score == by[801].score
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)


def test_no_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.predicted for r in ranking.rank_quality(docs_of([(1, "a", "", "")]), none).collect()] == [1]
    assert ranking.rank_quality(docs_of([]), none).count() == 0


def test_scores_equal_brute_force(spark, docs_of):
    """Pairs by loops, plain gradient steps to the same minimum, the cut by sorting, and each score by hand."""
    draw = random.Random(3)
    rows, marks = [], []
    for i in range(160):
        bad = i % 3 == 0
        rows.append((i, " ".join(("X" if bad and draw.random() < 0.5 else "y") * draw.randint(1, 6) for _ in range(draw.randint(3, 40))), "", ""))
        marks.append((i, int(not bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    counted = text_counts(docs_of(rows), ["doc_id"])
    known = {r.doc_id: tuple(r[1:]) for r in counted.select("doc_id", *[c.alias(n) for n, c in features().items()]).collect()}
    train = sorted((float(q), *known[i]) for i, q in marks if zlib.crc32(str(i).encode()) % 4 != 2)
    table = np.array(train)
    columns, names = [], []
    for k, name in enumerate(FEATURES):
        for knot in [None, *sorted(set(np.quantile(table[:, k + 1], ranking.KNOTS).tolist()))]:
            column = [x if knot is None else max(x - knot, 0) for x in table[:, k + 1]]
            if np.std(column) > 1e-9:
                columns.append(np.array(column) / np.std(column))
                names.append((k, knot, np.std(column)))
    z = np.array(columns).T
    good, bad = z[table[:, 0] == 1], z[table[:, 0] == 0]
    m = max(len(good), len(bad))
    pairs = np.array([good[j % len(good)] - bad[(j + (k * 7919) % m) % len(bad)] for k in range(ranking.PAIRS) for j in range(m)])
    model = ranking.fit_ranking(train)
    w = np.array([dict(((n, k), v) for n, k, v in model.terms)[FEATURES[k], knot] * s for k, knot, s in names])
    # the gradient of the pairs' logistic loss with its ridge is 0 there
    gradient = pairs.T @ (1 / (1 + np.exp(pairs @ w))) - ranking.RIDGE * w
    assert np.abs(gradient).max() < 1e-3
    scores = sorted(float(x @ w) for x in z)
    cut = np.quantile(scores, 1 - (table[:, 0] == 1).mean())
    scale = max(np.std(scores) / 4, 1e-9)
    for r in ranking.rank_quality(docs_of(rows), labels).collect():
        raw = sum(v / s * (known[r.doc_id][k] if knot is None else max(known[r.doc_id][k] - knot, 0)) for v, (k, knot, s) in zip(w, names))
        score = 1 / (1 + np.exp(-np.clip((raw - cut) / scale + np.log(0.7 / 0.3), -40, 40)))
        assert abs(r.score - score) < 1e-6


def test_labels_that_repeat_an_id_and_bounded_draws(spark, docs_of):
    rows = [(i, "word " * (i % 7 + 1), "", "") for i in range(60)]
    marks = [(i, i % 2) for i in range(60)]
    once = ranking.rank_quality(docs_of(rows), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    twice = ranking.rank_quality(docs_of(rows), spark.createDataFrame(marks + marks, "doc_id long, quality int")).collect()
    assert sorted(map(tuple, once)) == sorted(map(tuple, twice))
    few = [sorted(map(tuple, ranking.rank_quality(docs_of(r), spark.createDataFrame(marks, "doc_id long, quality int"), most_rows=10).collect())) for r in (rows, rows[::-1])]
    assert few[0] == few[1]
