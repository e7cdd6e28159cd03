"""Every operator and stage on one table of odd rows."""

import pytest

import corpus_pipeline
from quarry.llm import dedup, editcount, langid, mixing, mixlm, neardup, packing, ranking, rules, secrets

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
EXTRA = ["_id", "node", "name", "level", "count", "window", "row", "size", "word", "score", "_text", "_words", "copies", "at", "rank", "label", "block", "comp"]


@pytest.fixture(scope="module")
def messy(spark):
    base = " ".join(f"term{i}" for i in range(80))
    rows = [
        (1, base, "en", "a", len(base)), (1, base, "en", "a", len(base)), (2, base + " x", "en", None, 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", None, "b", 4), (None, "some words of a row without an id " * 9, "en", "b", 5),
        (None, None, None, None, None), (6, LONG, "en", "b", len(LONG)), (7, LONG + " tail", "de", "b", 1), (8, "x" * 300_000, "de", "c", 1), (9, "é" * 20 + " \x00 \x85 😀 token = \"" + "0af9" * 10 + "\"", None, "c", 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 0), (77, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").dropDuplicates()


def test_rows_in_rows_out(messy, labels):
    n = messy.count()
    one_each = {
        "rules": lambda: rules.judge(messy, labels), "langid": lambda: langid.identify(messy), "near": lambda: neardup.jaccard_classes(messy), "mix": lambda: mixing.mix(messy), "exact": lambda: dedup.exact_dedup(messy),
        "lm": lambda: mixlm.score_texts(messy), "rank": lambda: ranking.rank_quality(messy, labels), "edits": lambda: editcount.edited_counts(messy),
    }
    for name, run in one_each.items():
        assert run().count() == n, name


def test_links_and_copies(messy):
    near = {(r.doc_id, r.component_id) for r in neardup.jaccard_classes(messy).collect()}
    assert {(1, 1), (2, 1), (6, 6), (7, 6), (3, 3), (4, 4), (5, 5), (8, 8)} <= near
    exact = {(r.doc_id, r.keep_id, r.group_size) for r in dedup.exact_dedup(messy).collect()}
    assert {(1, 1, 2), (3, 4, 3), (4, 4, 3), (None, 4, 3), (6, 6, 1)} <= exact


def test_secrets_and_pieces(messy):
    assert {(r.doc_id, r.secret) for r in secrets.scan(messy).collect() if r.doc_id == 9} == {(9, True)}
    pieces = packing.pack(messy).collect()
    assert sum(r.start == 0 for r in pieces) == messy.count() and {r.doc_id for r in pieces if r.doc_tokens == 1} == {3, 4, None}


@pytest.mark.parametrize("keep", [rules.keep_good, neardup.drop_near_copies, dedup.drop_copies, mixing.mixed_documents])
def test_filters_keep_all_columns(messy, labels, keep):
    out = keep(messy, labels) if keep is rules.keep_good else keep(messy)
    assert out.columns == messy.columns
    out.collect()


def test_stages(spark, messy, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy, str(tmp_path))
        assert name == "pack" or out.columns == corpus_pipeline.COLUMNS
        out.collect()
