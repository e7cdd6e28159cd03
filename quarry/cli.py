"""Command line: questions, maintenance of the store, packs, symbols, reports, evaluation, the server."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rpc
from .config import Settings, expand
from .functions import paths
from .functions import text as T
from .operators import chunking, diffs, models, packs, symbols
from .operators.search import Engine
from .plans import measure, telemetry
from .plans.store import Store
from .sources import files as src
from .streaming import reindex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("text", nargs="+")
    q.add_argument("--top", type=int, default=5)
    q.add_argument("--scope")
    q.add_argument("--scope-repo")
    q.add_argument("--format", choices=["text", "json"], default="text")
    q.add_argument("--snippet", type=int, default=400)
    q.add_argument("--full", action="store_true")
    q.add_argument("--rerank", choices=["on", "off", "auto"], default="auto")
    q.add_argument("--fast", action="store_true")
    b = sub.add_parser("build")
    b.add_argument("--incremental", nargs="*")
    b.add_argument("--no-code", action="store_true")
    sub.add_parser("sessions").add_argument("days", nargs="?", type=int, default=30)
    k = sub.add_parser("pack")
    k.add_argument("task", nargs="+")
    k.add_argument("--files", nargs="*", default=[])
    k.add_argument("--diff", action="store_true")
    k.add_argument("--budget", type=int, default=4000)
    k.add_argument("--cwd")
    d = sub.add_parser("diff")
    one = d.add_mutually_exclusive_group(required=True)
    one.add_argument("--diff", action="store_true")
    one.add_argument("--pr", type=int)
    one.add_argument("--files", nargs="+")
    one.add_argument("--symbols", nargs="+")
    d.add_argument("--query", default="")
    d.add_argument("--budget", type=int, default=3000)
    sub.add_parser("symbols").add_argument("--files", nargs="*")
    sub.add_parser("report")
    e = sub.add_parser("eval")
    e.add_argument("--dataset", required=True)
    e.add_argument("--top", type=int, default=5)
    e.add_argument("--label", default="baseline")
    e.add_argument("--rerank", action="store_true")
    e.add_argument("--auto", action="store_true")
    e.add_argument("--verbose", action="store_true")
    e.add_argument("--out")
    e.add_argument("--baseline")
    e.add_argument("--tolerance", type=float, default=float(os.environ.get("TOL_PP", "5")))
    w = sub.add_parser("sweep")
    w.add_argument("--current", required=True)
    w.add_argument("--holdout")
    w.add_argument("--label")
    w.add_argument("--target", choices=list(measure.TARGETS), default="memory")
    w.add_argument("--top", type=int, default=5)
    w.add_argument("--rerank", action="store_true")
    w.add_argument("--note", default="")
    w.add_argument("--folder")
    w.add_argument("--lint", action="store_true")
    w.add_argument("--strict", action="store_true")
    c = sub.add_parser("calibrate")
    c.add_argument("--dataset", required=True)
    c.add_argument("--top", type=int, default=5)
    n = sub.add_parser("nightly")
    n.add_argument("--dataset")
    n.add_argument("--baseline")
    n.add_argument("--no-code", action="store_true")
    for name in ("follow", "refresh"):
        sub.add_parser(name).add_argument("folder")
    sub.add_parser("drift")
    sub.add_parser("serve").add_argument("--cold", action="store_true")
    return p


def listed(value: str | None) -> list[str] | None:
    return [x.strip() for x in value.split(",") if x.strip()] if value else None


def built(spark: SparkSession, settings: Settings, no_code: bool) -> DataFrame:
    """Chunks of all sources, with embeddings."""
    notes = src.note_files(spark, src.derived_sources(settings))
    found = notes if no_code else notes.unionByName(src.code_files(spark, settings))
    return embedded(chunk_paths(spark, found, settings), settings, None if no_code else src.commits(spark, settings))


def chunk_paths(spark: SparkSession, found: DataFrame, settings: Settings) -> DataFrame:
    texts = src.read_texts(spark, found)
    return chunking.chunk_files(texts.withColumn("repo", paths.repo_of(F.col("path"), settings.repos)), settings)


def embedded(chunks: DataFrame, settings: Settings, commits: DataFrame | None = None) -> DataFrame:
    out = chunks.drop("chunk_no")
    if commits is not None:
        prefix = T.context_prefix(F.col("source_type"), F.col("repo"), F.lit("git-log"), F.col("symbol"), F.col("text"))
        out = out.unionByName(commits.withColumn("embed_text", prefix))
    return models.embed(out, F.col("embed_text"), models.named("embed", settings.model), settings.dim).drop("embed_text")


def incremental(spark: SparkSession, store: Store, names: list[str], settings: Settings) -> int:
    """Purges the chunks of some files and adds those of the files that are still there."""
    places = [os.path.realpath(expand(p)) for p in names]
    given = spark.createDataFrame([(p, os.path.isfile(p)) for p in places], "path string, there boolean").withColumn("source_type", paths.source_type(F.col("path"), settings.code_globs))
    there = given.filter(F.col("there") & ~paths.is_quarantined(F.col("path"))).select("source_type", "path")
    return store.upsert(given, embedded(chunk_paths(spark, there, settings), settings))


def drift(spark: SparkSession, store: Store, marker: str, settings: Settings) -> int:
    """Reindexes files that changed since they were indexed, if there are some and the last look was long ago; how many."""
    hours = (time.time() - os.path.getmtime(marker)) / 3600 if os.path.exists(marker) else float("inf")
    known = store.read().filter(~F.col("path").startswith("git:") & (F.col("source_type") != "session"))
    there = src.read_texts(spark, known.select("source_type", "path").distinct())
    found = reindex.drifted(store, there.select("path", "file_sha"), hours)
    if found is None:
        return 0
    names = [r[0] for r in found.select("path").collect()]  # DRIFT_MOST at most
    incremental(spark, store, names, settings)
    with open(marker, "w") as f:
        f.write(str(time.time()))
    return len(names)


def index_symbols(spark: SparkSession, store: Store, known: symbols.SymbolStore, names: list[str] | None) -> str:
    """Fills the call graph, or only some files' part of it; says how many rows there are and how many files couldn't be read."""
    if names:
        chosen = spark.createDataFrame([(os.path.realpath(expand(n)),) for n in names], "path string")
    else:
        chosen = symbols.indexable(store.read())
    texts = src.read_texts(spark, chosen.withColumn("source_type", F.lit("code"))).persist()
    made = symbols.tables(symbols.extracted(texts, F.col("text"), paths.language(F.col("path")) if names else F.lit("python")))
    counts = known.replace(made, chosen.withColumnRenamed("path", "file")) if names else known.rebuild(made)
    unreadable = chosen.count() - texts.count()
    texts.unpersist()
    return ", ".join(f"{k}: {n}" for k, n in counts.items()) + f"; unreadable files: {unreadable}"


def lint_report(found: dict) -> str:
    out = [f"commands in {name}: {n}" for name, n in found["imperative"].items()]
    out.append(f"stale labels: {len(found['fixable'])} fixable, {len(found['coverage_gap'])} of code that isn't indexed")
    if found["by_scope"]:
        out.append("fixable by scope: " + ", ".join(f"{s}={n}" for s, n in sorted(found["by_scope"].items(), key=lambda x: (-x[1], x[0]))))
    for kind in ("fixable", "coverage_gap"):
        out += [f"{kind}: [{key}] {query[:48]} -> {', '.join(expect)}" for _, key, query, expect in found[kind]]
    return "\n".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    settings = Settings.from_env()
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    home = expand(settings.home)
    store = Store(spark, os.environ.get("RAG_DB", f"file://{home}/chunks"))
    log, graph = f"file://{home}/queries", symbols.SymbolStore(spark, f"file://{home}/symbols")
    engine = Engine.of_store(store, settings)

    def rebuilt(no_code: bool) -> int:
        store.check()
        return store.rebuild(built(spark, settings, no_code))

    if a.command == "query":
        rerank = {"on": True, "off": False, "auto": None}["off" if a.fast else a.rerank]
        text = " ".join(a.text)
        found = engine.search(text, a.top, listed(a.scope), listed(a.scope_repo), rerank=rerank).collect()
        telemetry.log_query(spark, log, found, text, listed(a.scope), listed(a.scope_repo), os.getcwd(), bool(rerank), settings.query_log)
        if a.format == "json":
            print(json.dumps([r.asDict() for r in found], ensure_ascii=False))
            return 0
        print(rpc.render(found, 10**9 if a.full else a.snippet, True))
        return 0 if found else 1
    if a.command == "build":
        if a.incremental is None:
            rebuilt(a.no_code)
        else:
            store.check()
            incremental(spark, store, a.incremental, settings)
    elif a.command == "sessions":
        folder = expand(os.environ.get("RAG_SESSIONS_DIR", f"{home}/sessions"))
        rows = src.transcripts(spark, f"file://{folder}", a.days)
        made = chunking.session_chunks(rows, "path", "line_no").join(rows.groupBy("path").agg(F.first("mtime").alias("mtime")), "path")
        none = F.lit(None).cast("string")
        made = made.select(F.lit("session").alias("source_type"), none.alias("repo"), none.alias("language"), none.alias("symbol"), "path", "start_line", "end_line", "text", F.col("sha").alias("file_sha"), "mtime")
        store.replace_type("session", models.embed(made, F.col("text"), engine.embed_factory, settings.dim))
    elif a.command == "pack":
        names = a.files + (src.git_changed(a.cwd or os.getcwd()) if a.diff else [])
        print(packs.task_pack(engine, " ".join(a.task), names, a.budget, a.cwd))
    elif a.command == "symbols":
        print(index_symbols(spark, store, graph, a.files))
        graph.views()
    elif a.command == "diff":
        if a.files or a.symbols:
            names = a.files or [s.split("::")[0] for s in a.symbols]
            sizes = [(n, sum(1 for _ in open(n, errors="replace")) if a.files and os.path.isfile(n) else 999) for n in names]
            changes = src.named_files(spark, sizes)
        else:
            changes = diffs.parsed(src.diff_lines(spark, sys.stdin.read() if a.diff else src.pull_request_diff(a.pr)), F.col("diff"))
        print(packs.diff_pack(engine, changes, graph.read("definitions"), graph.read("calls"), a.query, a.budget))
    elif a.command == "report":
        there = src.read_contents(spark, store.read().select("path").distinct())
        print(telemetry.report(telemetry.read_log(spark, log), store.read(), there, time.time()))
    elif a.command == "eval":
        mode = "auto" if a.auto else "rerank" if a.rerank else "fast"
        began, got = time.time(), measure.run(engine, a.dataset, a.top, None if a.auto else a.rerank)
        print(measure.told(a.label, got, time.time() - began, mode, a.verbose))
        place = a.out or os.path.join(home, f"{a.label}.json")
        os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
        with open(place, "w") as f:
            json.dump(got, f, indent=1)
        if a.baseline:
            with open(a.baseline) as f:
                rows = measure.compared(spark, got, json.load(f), a.tolerance)
            for r in rows:
                print(f"  {r['metric']:<6} {r['base']:.3f} {r['now']:.3f} {r['delta_pp']:+.1f}pp{'  regression' if r['failed'] else ''}")
            return int(any(r["failed"] for r in rows))
    elif a.command == "sweep":
        datasets = {"current": a.current} | ({"holdout": a.holdout} if a.holdout else {})
        if a.lint:
            found = measure.lint(engine, datasets)
            print(lint_report(found))
            return int(a.strict and bool(found["fixable"]))
        if not a.label:
            raise SystemExit("a label is needed")
        made = measure.sweep(engine, a.folder or os.path.join(home, "eval"), datasets, a.label, a.target, a.top, a.rerank, a.note)
        print(f"{a.label}: {made['verdict']} " + json.dumps({k: made[k] for k in ("memory", "overall_train", "holdout", "code")} | made["deltas"]))
    elif a.command == "calibrate":
        for name, (overall, code) in measure.floors(engine, a.dataset, a.top).items():
            print(f"{name}: overall={overall:.3f} code={code:.3f}")
        for r in measure.calibrate(engine, a.dataset, a.top).orderBy("rrf_k", "weight").collect():
            print(f"rrf_k={r['rrf_k']} weight={r['weight']} overall={r['overall']:.3f} ({r['overall_pp']:+.1f}pp) code={r['code']:.3f} ({r['code_pp']:+.1f}pp){'  *' if r['star'] else ''}")
    elif a.command == "nightly":
        said: list[str] = []
        good = measure.nightly(lambda: rebuilt(a.no_code), engine, a.dataset, a.baseline, lambda line: (print(line), said.append(line)))
        measure.alert(os.environ.get("RAG_ALERT_WEBHOOK", ""), f"nightly rebuild: {'done' if good else 'failed'}", "\n".join(said), good)
        return int(not good)
    elif a.command == "follow":
        folder = expand(a.folder)
        reindex.follow(spark, store, f"file://{folder}", f"file://{home}/follow", settings, engine.embed_factory).awaitTermination()
    elif a.command == "refresh":
        print("nothing changed" if reindex.refresh(store, f"file://{expand(a.folder)}", settings, engine.embed_factory) is None else "refreshed")
    elif a.command == "drift":
        print(f"{drift(spark, store, os.path.join(home, '.last-drift'), settings)} files")
    elif a.command == "serve":
        if not a.cold:
            rpc.prewarm(engine)
        rpc.serve(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main())
