import pathlib
import random

import pytest

import corpus_pipeline
from quarry.llm import mixing, rules
from quarry.llm.common import shared_dir
from test_neardup import brute as near_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(21)
    vocabulary = [f"w{k}" for k in range(2000)]
    bases = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(55, 120))) for _ in range(60)]
    rows = []
    for i in range(200):
        text = draw.choice(bases)
        if i % 3 == 0:
            text = text.replace(draw.choice(text.split()), "edited", 1)
        if i % 7 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", None, 0), (902, "few words", "en", "src1", 9)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_acts_on_what_the_last_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], folder).collect(), docs.schema))
        assert seen[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in d.collect()) for d in seen]
    good = {r.doc_id for r in rules.judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.kept}
    assert set(ids[1]) == good and not {900, 901, 902} & good and all(i % 7 for i in good)
    largest = {}
    for r in seen[1].collect():
        largest[r.text] = max(largest.get(r.text, -1), r.doc_id)
    assert ids[2] == sorted(largest.values())
    assert ids[3] == sorted(i for i, _, c in near_brute([(r.doc_id, r.text) for r in seen[2].collect()]) if i == c)
    taken = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(seen[3]).collect()}
    assert ids[4] == sorted(i for i, n in taken.items() for _ in range(n))
    packed = corpus_pipeline.pack(spark, seen[4], folder).collect()
    assert sum(r.start == 0 for r in packed) == len(ids[4])


def test_run_is_the_stages_in_order(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(0 < r.length <= 1024 for r in rows)


def test_empty_table(spark, docs_of, folder):
    docs = docs_of([]).drop("name")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_repeated_ids_go_through_by_their_texts(spark, folder, tmp_path):
    """One doc_id under several texts, repeated rows and null ids: each stage keeps and drops rows, not ids."""
    long = [" ".join(f"{p}{k}" for k in range(70)) for p in "abcdef"]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (2, long[0].upper()), (3, long[2]), (3, "short"), (4, long[2] + " tail"), (None, long[3]), (None, long[3]), (5, None), (5, long[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = [
        [r for r in rows if r[1] and r[1] != "short"],
        [(2, long[0].upper()), (1, long[1]), (3, long[2]), (4, long[2] + " tail"), (None, long[3]), (5, long[4])],
        [(2, long[0].upper()), (1, long[1]), (3, long[2]), (None, long[3]), (5, long[4])],
    ]
    for (_, stage), kept in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(kept, key=str)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()} <= set(want[-1])


def test_run_leaves_only_what_its_result_needs(spark, folder):
    shared = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    there = lambda: {p.name for p in shared.glob("quarry-*")}
    before = there()
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert sorted(n.split("-")[1] for n in there() - before) == ["mix_sources", "pieces"]
