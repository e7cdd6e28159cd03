import http.server
import io
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry import cli, rpc
from quarry.config import Settings, load_sources, purpose_types
from quarry.operators import models, symbols
from quarry.operators.search import Engine
from quarry.plans import evaluate, measure, store, telemetry
from quarry.sources import files as src
from quarry.streaming import reindex


def chunks(spark, rows):
    full = [(t, None, "text", "", p, 1, 1, x, "sha", 1.0) for t, p, x in rows]
    return spark.createDataFrame(full, "source_type string, repo string, language string, symbol string, path string, start_line int, end_line int, text string, file_sha string, mtime double")


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/c", keep=2, buckets=64)
    assert s.read().count() == 0 and s.check()
    s.rebuild(chunks(spark, [("memory", "a", "1"), ("session", "b", "2")]))
    s.upsert(spark.createDataFrame([("a",), ("gone",)], "path string"), chunks(spark, [("memory", "a", "new"), ("memory", "a", "more")]))
    assert sorted(r.text for r in s.read().collect()) == ["2", "more", "new"]
    assert s.replace_type("session", chunks(spark, [])) is None
    s.replace_type("session", chunks(spark, [("session", "c", "3")]))
    assert sorted(r.path for r in s.read().collect()) == ["a", "a", "c"] and s.current() == 3
    # parts that a change doesn't touch are taken over; those that no kept snapshot has are gone
    assert {p.split("/")[0] for p in s.parts(3)} == {"v=2", "v=3"} and {p.split("/")[0] for p in s.parts(2)} == {"v=1", "v=2"} and s.parts(1) == []
    assert sum(len([n for n in names if n.endswith(".parquet")]) for _, _, names in os.walk(tmp_path / "c" / "v=1")) == 1
    for folder, _, names in os.walk(tmp_path / "c" / "v=3"):
        for n in names:
            if n.endswith(".parquet"):
                open(os.path.join(folder, n), "wb").write(b"broken")
    for folder, _, names in os.walk(tmp_path / "c" / "v=3"):
        for n in names:
            if n.endswith(".crc"):
                os.remove(os.path.join(folder, n))
    assert not s.check() and s.current() == 2 and s.read().count() == 3


def vectors_of(df):
    return models.embed(df, F.col("text"), dim=16)


def test_an_engine_follows_the_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/c", keep=1)
    s.rebuild(vectors_of(chunks(spark, [("memory", "a", "old words of a board")])))
    engine = Engine.of_store(s, Settings(dim=16))
    find = lambda: [r.text for r in engine.search("board", 5, None, ["all"], rerank=False).collect()]
    assert find() == ["old words of a board"] and os.path.isdir(tmp_path / "c/_INDEX/1")
    again = Engine.of_store(s, Settings(dim=16))
    assert [r.text for r in again.search("board", 5, None, ["all"], rerank=False).collect()] == find()  # from the stored index
    s.rebuild(vectors_of(chunks(spark, [("memory", "a", "old words of a board"), ("memory", "b", "new board")])))
    assert sorted(find()) == ["new board", "old words of a board"] and not os.path.isdir(tmp_path / "c/_INDEX/1")
    engine.warm()
    assert len(engine.indexes) == 2


def test_query_log(spark, tmp_path):
    path = f"file://{tmp_path}/q"
    assert not telemetry.log_query(spark, path, [], "x", None, None, "/", False) and not telemetry.log_query(spark, path, [], " ", None, None, "/", False, True)
    assert telemetry.log_query(spark, path, [{"cos": 0.5, "path": "p"}], "y" * 600, ["a", "b"], "r", "/", True, True, now=1000.0)
    row = spark.read.parquet(path).first()
    assert len(row.query) == 500 and row.scope_types == "a,b" and row.top_score == 0.5
    text = telemetry.report(spark.read.parquet(path), chunks(spark, [("memory", "a", "1")]).withColumn("id", F.lit(1)), spark.createDataFrame([], "path string, content binary"), 1001.0)
    assert "missing: a" in text and "1 x y" in text


def test_frozen_metrics_and_gate(spark):
    ranks = [1, 1, 2, 4, None]
    cases = spark.createDataFrame([(i, f"q{i}", ["code"] if i % 2 else None, r) for i, r in enumerate(ranks)], "case_id int, query string, scope array<string>, hit_rank int")
    got = {r.scope: r for r in evaluate.metrics(cases).collect()}
    assert (got[None].n, got[None].mrr, got[None].hit1, got[None].hit3, got[None].hit5) == (5, 0.55, 0.4, 0.6, 0.8) and set(got) == {None, "none", "code"}


def test_decisions():
    base = {"memory": 0.8, "holdout_memory": 0.7, "skills": 0.5, "holdout": 0.6, "code": None}
    assert evaluate.decide(base | {"skills": 0.52}, base, "skills")[0] == "KEEP" and evaluate.decide(base | {"memory": 0.7, "skills": 0.9}, base, "skills")[0] == "REVERT"
    assert evaluate.decide(base, None, "skills")[0] == "NO-BASE" and evaluate.decide(base, base, "skills", True)[0] == "BASELINE" and evaluate.decide(base, base, "code")[0] == "REVERT"
    row = measure.ledger_row("x", "overall", base | {"holdout": 0.7}, base, "now", "KEEP", " note")
    assert row == "| x | overall | 0.800 | — | 0.700 | — | +0.0pp | +10.0pp | KEEP | now note |\n" and "| NO-BASE |" in measure.ledger_row("x", "code", base, None, "now", "NO-BASE")


def test_stream_keeps_the_store_up_to_date(spark, tmp_path):
    folder = tmp_path / "notes" / "memory"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("first note " * 10)
    s = store.Store(spark, f"file://{tmp_path}/c")
    reindex.follow(spark, s, f"file://{tmp_path}/notes", f"file://{tmp_path}/cp", Settings(dim=16)).awaitTermination()
    assert [r.source_type for r in s.read().collect()] == ["memory"]
    time.sleep(1.1)
    (folder / "a.md").write_text("second note " * 10)
    (folder / "b.md").write_text("other note " * 10)
    reindex.follow(spark, s, f"file://{tmp_path}/notes", f"file://{tmp_path}/cp", Settings(dim=16)).awaitTermination()
    # the stream sees a path once; what changes later is found by its time
    assert sorted(r.text.split()[0] for r in s.read().collect()) == ["first", "other"]
    reindex.refresh(s, f"file://{tmp_path}/notes", Settings(dim=16))
    assert sorted(r.text.split()[0] for r in s.read().collect()) == ["other", "second"]
    os.remove(folder / "b.md")
    reindex.refresh(s, f"file://{tmp_path}/notes", Settings(dim=16))
    assert [r.text.split()[0] for r in s.read().collect()] == ["second"] and reindex.refresh(s, f"file://{tmp_path}/notes", Settings(dim=16)) is None
    files = spark.createDataFrame([(f"/x/{i}", "s") for i in range(40)], "path string, file_sha string")
    assert reindex.drifted(s, files, 7).count() == 25 and reindex.drifted(s, files, 1) is None and reindex.drifted(s, files.limit(2), 7) is None


@pytest.fixture
def tree(tmp_path):
    repo = tmp_path / "app"
    for p, text in {"docs/specs/s.md": "spec", "docs/a.md": "doc", "README.md": "readme", "src/x.py": "def f(): pass", "node_modules/y.js": "z", "quarantine/q.md": "q"}.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(text)
    (repo / "big.py").write_text("#" * 200_001)
    return repo


def test_sources(spark, tree):
    s = Settings(repos=(str(tree),), sources=(("memory", f"{tree}/quarantine/*.md"),))
    notes = {os.path.relpath(r.path, tree): r.source_type for r in src.note_files(spark, src.derived_sources(s)).collect()}
    assert notes == {"docs/specs/s.md": "spec", "docs/a.md": "repo-docs", "README.md": "repo-readme"}
    assert [os.path.relpath(r.path, tree) for r in src.code_files(spark, s).collect()] == ["src/x.py"]
    texts = src.read_texts(spark, src.code_files(spark, s)).first()
    assert texts.text == "def f(): pass" and len(texts.file_sha) == 40
    (tree / "graphify-out").mkdir()
    (tree / "graphify-out/graph.json").write_text("{}")
    assert src.code_files(spark, s).count() == 0 and src.commit_log(str(tree)) == []


def test_transcripts_and_cases(spark, tmp_path):
    lines = [
        {"message": {"content": "plain"}}, {"message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "T", "input": {"k": 1}}, {"type": "tool_result", "content": [{"text": "r"}, "s"]}]}},
        {"message": {"content": [{"type": "text", "text": "keep<system-reminder>drop"}]}}, {"message": {}}, {"other": 1},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n\n")
    (tmp_path / "agent-acompact-1.jsonl").write_text(json.dumps(lines[0]))
    got = [r.text for r in src.transcripts(spark, f"file://{tmp_path}", 1).orderBy("line_no").collect()]
    assert got == ["plain", 'a\n[Tool: T] {"k":1}\n[Result] r s', "keep"]
    (tmp_path / "d.jsonl").write_text('{"query":"q","expect_path_contains":["a","b"],"expect_scope":"code"}\n\n{"query":"r","expect_path_contains":"c"}\n{"id":1}\n')
    rows = src.cases(spark, f"file://{tmp_path}/d.jsonl").collect()
    assert [tuple(r) for r in rows] == [("q", ["a", "b"], ["code"]), ("r", ["c"], None)]


def test_config(tmp_path):
    assert load_sources(tmp_path / "x" / "s.yaml") == {} and (tmp_path / "x" / "s.yaml").exists()
    (tmp_path / "bad.yaml").write_text("- a")
    with pytest.raises(SystemExit):
        load_sources(tmp_path / "bad.yaml")
    assert purpose_types("off") == () and purpose_types("both") == ("memory", "skills") and purpose_types("memory,x") == ("memory",)
    (tmp_path / "s.yaml").write_text("repos: null\nsources: [{type: memory, glob: /n/*.md}]\n")
    s = Settings.from_env({"RAG_SOURCES": str(tmp_path / "s.yaml"), "RAG_BM25_WEIGHT": "2"})
    assert s.repos == () and s.sources == (("memory", "/n/*.md"),) and s.bm25_weight == 2.0


def test_server(spark):
    df = models.embed(store.with_ids(chunks(spark, [("memory", "/a", "some board text")])).drop("embedding"), F.col("text"), dim=16)
    engine = Engine(df, Settings(dim=16))
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search_knowledge", "arguments": {"query": "board", "top": "99"}}}, {"id": 4, "method": "nope"}, {"id": 5, "method": "tools/call", "params": {"name": "rag_query", "arguments": {}}}]
    out = io.StringIO()
    rpc.serve(engine, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out)
    got = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5} and "board" in got[3]["result"]["content"][0]["text"] and got[4]["error"]["code"] == -32601 and got[3]["result"]["isError"] is False and got[5]["result"]["content"][0]["text"] == "No matches."
    log = io.StringIO()
    rpc.prewarm(engine, log).join()
    assert log.getvalue() == "warm\n"
    engine.embed_factory = lambda: None
    assert rpc.answer(engine, {"id": 6, "method": "tools/call", "params": {"name": "rag_query", "arguments": {"query": "board"}}})["error"]["code"] == -32000


def test_command_line(spark, tree, tmp_path, monkeypatch, capsys):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/sources.yaml").write_text(f"repos: [{tree}]\n")
    (tree / "docs/a.md").write_text("the scoring board is drawn by the painter module in pure software\n" * 3)
    (tree / "docs/specs/s.md").write_text("the spec says how a run of the whole plan is done\n" * 3)
    monkeypatch.setenv("RAG_HOME", str(tmp_path / "h"))
    monkeypatch.setenv("RAG_DIM", "16")
    assert cli.main(["build"], spark) == 0
    assert cli.main(["query", "painter board", "--scope-repo", "all", "--fast"], spark) == 0 and "docs/a.md" in capsys.readouterr().out
    assert cli.main(["query", "painter", "--scope", "none", "--fast"], spark) == 1
    os.remove(tree / "docs/a.md")
    assert cli.main(["build", "--incremental", str(tree / "docs/a.md")], spark) == 0
    assert cli.main(["symbols"], spark) == 0 and cli.main(["report"], spark) == 0
    (tmp_path / "d.jsonl").write_text('{"query":"painter","expect_path_contains":"docs/a.md"}\n{"query":"then run the spec","expect_path_contains":"docs/specs","expect_scope":"spec"}\n')
    data = f"file://{tmp_path}/d.jsonl"
    capsys.readouterr()
    assert cli.main(["sweep", "--current", data, "--lint"], spark) == 0 and cli.main(["sweep", "--current", data, "--lint", "--strict"], spark) == 1
    told = capsys.readouterr().out
    assert "commands in current: 1" in told and "1 fixable" in told and "fixable by scope: none=1" in told
    assert cli.main(["eval", "--dataset", data, "--label", "one", "--verbose"], spark) == 0
    kept = json.loads((tmp_path / "h/one.json").read_text())
    assert kept["n"] == 2 and kept["hit@1"] == 0.5 and [c["hit_rank"] for c in kept["per_case"]] == [None, 1] and kept["per_case"][1]["top_hit"].endswith("docs/specs/s.md:1")
    (tmp_path / "better.json").write_text(json.dumps(kept | {"hit@1": 1.0}))
    assert cli.main(["eval", "--dataset", data, "--baseline", str(tmp_path / "better.json")], spark) == 1 and cli.main(["eval", "--dataset", data, "--baseline", str(tmp_path / "h/one.json")], spark) == 0
    for label in ("baseline", "again"):
        assert cli.main(["sweep", "--current", data, "--holdout", data, "--label", label, "--target", "overall"], spark) == 0
    ledger = (tmp_path / "h/eval/RESULTS.md").read_text().splitlines()
    assert len(ledger) == 4 and "| BASELINE |" in ledger[2] and "| REVERT |" in ledger[3]
    capsys.readouterr()
    assert cli.main(["calibrate", "--dataset", data], spark) == 0
    told = capsys.readouterr().out.splitlines()
    assert told[0].startswith("fusion: overall=0.500") and len(told) == 13 and not any(x.endswith("*") for x in told)
    assert cli.main(["nightly", "--dataset", data, "--baseline", str(tmp_path / "better.json")], spark) == 1 and cli.main(["nightly"], spark) == 0
    assert cli.main(["drift"], spark) == 0 and capsys.readouterr().out.endswith("0 files\n")
    for k in range(3):
        (tree / f"docs/n{k}.md").write_text(f"note {k} about the long drift of things " * 3)
    cli.main(["build", "--incremental", *[str(tree / f"docs/n{k}.md") for k in range(3)]], spark)
    for k in range(3):
        (tree / f"docs/n{k}.md").write_text(f"changed {k} about the long drift of things " * 3)
    assert cli.main(["drift"], spark) == 0 and capsys.readouterr().out.endswith("3 files\n")
    assert cli.main(["drift"], spark) == 0 and capsys.readouterr().out.endswith("0 files\n")  # looked lately
    assert cli.main(["refresh", str(tree / "docs")], spark) == 0 and cli.main(["follow", str(tree / "docs")], spark) == 0


def test_symbol_store(spark, tmp_path):
    known = symbols.SymbolStore(spark, f"file://{tmp_path}/s")
    found = lambda rows: symbols.tables(symbols.extracted(spark.createDataFrame(rows, "path string, text string"), F.col("text"), F.lit("python")))
    assert known.read("calls").count() == 0
    assert known.rebuild(found([("a.py", "import os\ndef f():\n    g()\n"), ("b.py", "def g(): pass\n")])) == {"definitions": 2, "imports": 1, "calls": 1}
    files = spark.createDataFrame([("a.py",), ("c.py",)], "file string")
    assert known.replace(found([("a.py", "def h():\n    g()\n    g()\n")]), files) == {"definitions": 2, "imports": 0, "calls": 1}
    assert sorted(r.symbol_name for r in known.read("definitions").collect()) == ["g", "h"]
    known.views()
    assert [tuple(r) for r in spark.sql("select callee, caller, file, line_in_caller from symbols_called_by").collect()] == [("g", "h", "a.py", 2)]


def test_cases_of_code(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"query":"where is the board drawn","expect_path_contains":"app/x","expect_scope":"code"}\n{"query":"board painter","expect_path_contains":["/lib/y"],"expect_scope":["code"]}\n')
    rows = [("code", "app", "typescript", "", "/r/app/x.ts", 1, 1, "the board painter of app", "s", 1.0), ("code", "lib", "typescript", "", "/r/lib/y.ts", 1, 1, "one board among many words of a painter", "s", 1.0)]
    df = spark.createDataFrame(rows, "source_type string, repo string, language string, symbol string, path string, start_line int, end_line int, text string, file_sha string, mtime double")
    engine = Engine(store.with_ids(vectors_of(df)), Settings(dim=16, repos=("/r/app", "/r/lib")))
    data = f"file://{tmp_path}/d.jsonl"
    every, some = measure.run(engine, data), measure.run(engine, data, exclude_lookups=True, scope_by_repo=True)
    assert every["n"] == 2 and every["excluded_symbol_lookup"] == 0 and some["n"] == 1 and some["excluded_symbol_lookup"] == 1
    assert some["per_case"][0]["hit_rank"] == 1 and some["by_scope"]["code"]["hit@1"] == 1.0 and list(every["by_scope"]) == ["code"]
    assert [r.star for r in measure.calibrate(engine, data).collect()].count(True) == 0


def test_models_are_loaded_once():
    loads = []

    def local():
        loads.append(1)
        return len

    assert models.once(local) is len and models.once(local) is len and len(loads) == 2
    assert models.once(loader) is models.once(loader) and models.named("embed", "") is None and models.named("rerank", "m") == models.Named("rerank", "m")


def loader():
    return object()


def test_alerts_reach_a_webhook_and_never_fail():
    got = []

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert measure.alert(f"http://127.0.0.1:{server.server_port}/", "t", "a\nb", False) and got == [{"embeds": [{"title": "t", "description": "a\nb", "color": measure.BAD}]}]
    finally:
        server.shutdown()
    assert not measure.alert("", "t", "", True) and not measure.alert("http://127.0.0.1:9/", "t", "", True) and not measure.alert("no address", "t", "", True)
