import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import allpairs, fusion
from quarry.plans import evaluate


def made(spark, n, seed, parts=5):
    draw = random.Random(seed)
    kinds = [[draw.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)] for _ in range(n // 3)]
    return [(k, draw.choice(kinds)) for k in range(n)], lambda rows: spark.createDataFrame(rows, "id long, embedding array<float>").repartition(parts)


@pytest.mark.parametrize("seed", range(2))
def test_ranks_and_best_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(allpairs, "ROWS", 16)  # workers have their own value; blocks of tasks are small anyway
    rows, frame = made(spark, 120, seed)
    rows[7] = (7, None)
    asked, given, width = [r for r in rows if r[0] % 10 == 0], [r for r in rows if r[0] in (3, 7, 10, 55, 119)], 6
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    wanted, two = set(), {}
    for case, vector in asked:
        others = sorted((-dot(v, vector) if v else 99.0, k) for k, v in rows if k != case)
        place = {k: n for n, (_, k) in enumerate(others, 1)}
        wanted |= {(case, k, n) for k, n in place.items() if n <= width or k in (3, 7, 10, 55, 119)}
        two[case] = tuple(-s for s, _ in others[:2])
    found = allpairs.ranks(frame(rows), frame(asked), frame(given), width).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    best = {r["query_id"]: (r["a"], r["b"]) for r in allpairs.two_best(frame(rows), frame(asked)).collect()}
    assert best == two


def test_one_other_row_has_no_second_best(spark):
    _, frame = made(spark, 3, 0)
    assert allpairs.two_best(frame([(0, [1.0]), (1, [0.5])]), frame([(0, [1.0])])).collect() == [(0, 0.5, None)]


def test_ranks_of_all_rows(spark):
    rows = [(k, float(k % 7)) for k in range(500)]
    found = fusion.everywhere(spark.createDataFrame(rows, "id long, s double").repartition(9), "s", "rank").collect()
    assert sorted(map(tuple, found)) == sorted((k, n) for n, (_, k) in enumerate(sorted((-s, k) for k, s in rows), 1))


def test_calibration_needs_no_row_behind_its_reach(spark):
    draw = random.Random(1)
    rows = []
    for case in range(6):
        by_cos, by_words = random.Random(case).sample(range(400), 400), draw.sample(range(400), 400)
        rows += [(case, k, k % 9 == 0, by_cos[k] + 1, by_words[k] + 1) for k in range(400)]
    ranked, n = spark.createDataFrame(rows, "case_id long, id long, relevant boolean, rank_cos long, rank_bm25 long"), evaluate.reach()
    some = ranked.filter((F.col("rank_cos") <= n) | (F.col("rank_bm25") <= n))
    assert sorted(map(tuple, evaluate.calibration(some).collect())) == sorted(map(tuple, evaluate.calibration(ranked).collect()))
