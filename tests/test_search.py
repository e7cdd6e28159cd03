import math

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators import diffs, fusion, models, packs
from quarry.operators.search import Engine, scopes


@pytest.fixture(scope="module")
def engine(spark):
    texts = [
        ("code", "app", "createPlayer", "/r/app/a.ts", "function createPlayer makes a new player of the game"),
        ("code", "app", "", "/r/app/b.ts", "the score board of the game lists players"),
        ("memory", None, None, "/n/memory/c.md", "we decided to keep the board simple"),
        ("standards", "app", "", "/n/standards/d.md", "tests come with every change of the board"),
        ("memory", None, "", "/n/memory/e.md", "unrelated words about cooking"),
        ("code", "app", "", "/r/app/a.test.ts", "test createPlayer twice"),
    ]
    rows = [(i, t, r, "x", s, p, 1, 2, x, "sha", i * 20 * 86400.0) for i, (t, r, s, p, x) in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, source_type string, repo string, language string, symbol string, path string, start_line int, end_line int, text string, file_sha string, mtime double")
    return Engine(models.embed(df, F.col("text"), dim=32), Settings(dim=32))


def test_symbol_boost_leads(engine):
    got = engine.search("createPlayer", 3, scope_repos=["all"], rerank=False).collect()
    assert got[0]["symbol"] == "createPlayer" and [r["rank"] for r in got] == [1, 2, 3] and not got[0]["reranked"]


def test_blank_queries_and_empty_scopes(engine):
    assert engine.search("  ").count() == 0 and engine.search("x", scope_types=["nothing"]).count() == 0


def test_scopes(engine):
    assert {r["source_type"] for r in engine.search("board", 5, "memory", ["all"], rerank=False).collect()} == {"memory"}
    assert all(r["repo"] == "app" for r in engine.search("board", 9, None, ["app"], rerank=False).collect())
    assert scopes("all", ["all"], Settings()) == (None, None) and scopes(["a"], "r", Settings()) == (["a"], ["r"])


def test_failing_reranker_falls_back(engine):
    def broken():
        def score(pairs):
            raise RuntimeError("no model")

        return score

    plain = engine.search("board game", 3, scope_repos=["all"], rerank=False).collect()
    failed = Engine(engine.chunks, engine.settings, None, broken).search("board game", 3, scope_repos=["all"], rerank=True).collect()
    assert [r["id"] for r in plain] == [r["id"] for r in failed] and not failed[0]["reranked"]


def test_custom_models_run_in_workers(engine):
    def reverse():
        return lambda pairs: [-float(len(t)) for _, t in pairs]

    got = Engine(engine.chunks, engine.settings, None, reverse).search("board", 3, scope_repos=["all"], rerank=True).collect()
    assert got[0]["reranked"] and len(got[0]["text"]) <= len(got[1]["text"])


def test_null_symbol_is_the_word_none(engine):
    got = engine.search("none", 6, ["memory"], ["all"], rerank=False).collect()
    assert {r["id"]: r["bm25"] > 0 for r in got} == {2: True, 4: False} or math.isclose(sum(r["bm25"] for r in got), 0.0)


def test_rerank_choice(spark):
    s = Settings()
    wants = lambda a, b, scope, settings: spark.range(1).select(fusion.wants_rerank(F.lit(a), F.lit(b), scope, settings)).first()[0]
    assert wants(0.3, 0.1, None, s) and wants(0.9, 0.85, None, s) and not wants(0.9, 0.5, None, s)
    assert not wants(0.3, 0.1, ["memory"], Settings(code_rerank=True)) and wants(0.9, 0.1, ["code"], Settings(code_rerank=True)) and wants(1.0, 0.0, None, Settings(rerank=True))
    assert fusion.window_size(50, 5) == 50 and fusion.window_size(900, 10) == 160 and fusion.rerank_size(900, 3) == 20


def test_recency_moves_close_memory_notes(engine):
    fresh = engine.with_settings(recency_weight=5.0).search("zzz", 6, ["memory"], ["all"], rerank=False).collect()
    assert fresh[0]["id"] == 4


def test_task_pack_keeps_the_budget(engine):
    text = packs.task_pack(engine, "createPlayer board", budget=60)
    assert text.startswith("# Context pack for: createPlayer board") and "remaining" in text and len(text) // 4 < 60 + 60


def test_greedy_and_prefix(spark):
    costs = spark.range(1).select(packs.greedy_budget(F.array(*[F.lit(c) for c in (5, 9, 3, 2)]), 10).alias("t")).first().t
    assert costs == [0, 2, 3]
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 1)], "g string, o int, c int")
    assert [r.o for r in packs.within_budget(rows, "g", "o", "c", 10).collect()] == [1]


def test_diff_pack(spark, engine):
    changes = spark.createDataFrame([("/r/app/a.ts", 1, 1, [1, 2])], "file string, old_start int, new_start int, added_lines array<int>")
    defs = spark.createDataFrame([("/r/app/a.ts", "createPlayer", "typescript", 1, 3)], "file string, symbol_name string, language string, start_line int, end_line int")
    calls = spark.createDataFrame([("/r/app/b.ts", "board", "createPlayer", 4)], "file string, caller string, callee string, line_in_caller int")
    text = packs.diff_pack(engine, changes, defs, calls, "board")
    assert "## Modified symbols" in text and "## Callers (1-hop)" in text and "## Tests" in text and "a.test.ts" in text and "## Applicable standards" in text
    assert packs.diff_pack(engine, changes.limit(0), defs, calls) == "(no changes detected)"
    assert diffs.callers(spark.createDataFrame([("x::createPlayer",)], "symbol_id string"), calls, True).count() == 0


def test_parse_diffs():
    assert diffs.parse("") == [] and diffs.parse(None) == []
    one = "--- a/f.py\n+++ b/f.py\n@@ -12,7 +12,9 @@\n ctx\n-gone\n+one\n+two\n+three\n"
    assert diffs.parse(one) == [("f.py", 12, 12, [13, 14, 15])] and diffs.parse(one, True) == [("f.py", 12, 12, [14, 15, 16])]
    assert diffs.parse("--- /dev/null\n+++ b/new.ts\n@@ -0,0 +1,2 @@\n+a\n+b\n") == [("new.ts", 0, 1, [1, 2])]
