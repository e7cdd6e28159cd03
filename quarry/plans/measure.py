"""Measurements over evaluation datasets: a run, snapshots and their ledger, calibration, the gate, the nightly rebuild.

A dataset is some dozens of questions, each of which is a search of its own; what follows from the hits is computed by frames.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.search import Engine
from ..sources import files as src
from . import evaluate

#: Names of metrics in files, and in frames.
NAMES = {"mrr": "mrr", "hit@1": "hit1", "hit@3": "hit3", "hit@5": "hit5"}
TARGETS = {"memory": "memory", "skills": "skills", "code": "code", "overall": "holdout"}
LEDGER_HEAD = "| label | target | mem h@5 | overall (train) | holdout h@5 | code h@5 | mem Δ | target Δ | verdict | when |\n|---|---|---|---|---|---|---|---|---|---|\n"


def on(name: str) -> bool:
    return os.environ.get(name, "0").lower() in ("1", "on", "true")


def numbered(spark: SparkSession, dataset: str, repos: tuple[str, ...] = ()) -> DataFrame:
    """Cases with case_id, scope key, whether they look up a symbol of code, and the repo that their label names."""
    cases = src.cases(spark, dataset).withColumn("case_id", F.row_number().over(Window.orderBy("query", F.to_json("expect"))))
    key = paths.scope_key(F.col("scope"))
    names = [os.path.basename(r.rstrip("/")) for r in repos]
    repo = paths.inferred_repo(F.col("expect"), names) if names else F.lit(None).cast("string")
    return cases.select("*", key.alias("key"), (key.contains("code") & paths.is_symbol_lookup(F.col("query"))).alias("lookup"), F.when(key.contains("code"), repo).alias("repo"))


def run(engine: Engine, dataset: str, top: int = 5, rerank: bool | None = False, exclude_lookups: bool | None = None, scope_by_repo: bool | None = None) -> dict:
    """n, mrr, hit@k, by_scope, per_case (query, expect, scope, hit_rank, top_hit), excluded_symbol_lookup.

    exclude_lookups leaves out questions that ask where a symbol of code is; scope_by_repo searches code in the repo that the label
    names. Without them the environment decides.
    """
    exclude = on("RAG_EVAL_EXCLUDE_SYMBOL_LOOKUP") if exclude_lookups is None else exclude_lookups
    narrow = on("RAG_EVAL_CWD_SCOPE") if scope_by_repo is None else scope_by_repo
    spark = engine.chunks.sparkSession
    every = numbered(spark, dataset, engine.settings.repos).persist()
    cases = every.filter(~F.col("lookup")) if exclude else every
    rows = []
    for c in cases.orderBy("case_id").collect():
        repos = [c["repo"]] if narrow and c["repo"] else ["all"]
        rows += [(c["case_id"], h["rank"], h["path"], h["start_line"]) for h in engine.search(c["query"], top, c["scope"], repos, rerank=rerank).collect()]
    hits = spark.createDataFrame(rows, "case_id int, rank int, path string, start_line int")
    ranked = evaluate.hit_ranks(cases, hits).persist()
    first = hits.filter("rank = 1").select("case_id", F.concat_ws(":", "path", "start_line").alias("top_hit"))
    told = ranked.join(first, "case_id", "left").orderBy("case_id").collect()
    by_scope = {r["scope"]: {"n": r["n"]} | {k: r[v] for k, v in NAMES.items()} for r in evaluate.metrics(ranked).collect()}
    memory = evaluate.memory_hit5(ranked).first()
    out = by_scope.pop(None, {"n": 0} | dict.fromkeys(NAMES, 0.0))
    out |= {"by_scope": dict(sorted(by_scope.items())), "per_case": [{"query": r["query"], "expect": r["expect"], "scope": r["key"], "hit_rank": r["hit_rank"], "top_hit": r["top_hit"]} for r in told]}
    out |= {"excluded_symbol_lookup": every.filter("lookup").count() if exclude else 0, "memory_target": memory["hit5"], "memory_target_n": memory["n"]}
    ranked.unpersist()
    every.unpersist()
    return out


def told(label: str, result: dict, seconds: float, mode: str, verbose: bool = False) -> str:
    out = [f"[{label}] [{mode}]  n={result['n']}  " + "  ".join(f"{k}={result[k]}" for k in NAMES) + f"  ({seconds:.1f}s)"]
    out += [f"    scope={s}  n={m['n']}  hit@1={m['hit@1']}  hit@5={m['hit@5']}  mrr={m['mrr']}" for s, m in result["by_scope"].items()]
    if verbose:
        out += [f"  {'#' + str(c['hit_rank']) if c['hit_rank'] else 'MISS'}  {c['query'][:60]}  {c['top_hit']}" for c in result["per_case"]]
    return "\n".join(out)


def compared(spark: SparkSession, now: dict, base: dict, tolerance: float = evaluate.TOLERANCE_PP) -> list:
    """Rows metric, base, now, delta_pp, failed of two results."""
    frame = lambda r: spark.createDataFrame([(k, float(r[k])) for k in NAMES if k in r], "metric string, value double")
    return evaluate.gate(frame(now), frame(base), tolerance).orderBy("metric").collect()


# ---- snapshots and their ledger

def snapshot(engine: Engine, datasets: dict[str, str], top: int = 5, rerank: bool = False) -> dict:
    """The numbers that settings are judged by, of the datasets current and holdout."""
    found = {}
    for name, path in datasets.items():
        began, r = time.time(), run(engine, path, top, rerank)
        found[name] = {"n": r["n"], "overall": r["hit@5"], "mrr": r["mrr"], "by_scope": {s: m["hit@5"] for s, m in r["by_scope"].items()}, "memory_target": r["memory_target"], "memory_target_n": r["memory_target_n"], "elapsed_s": round(time.time() - began, 1)}
    current, holdout = found.get("current", {}), found.get("holdout", {})
    scope = lambda d, s: d.get("by_scope", {}).get(s)
    return {
        "datasets": found, "memory": current.get("memory_target"), "memory_n": current.get("memory_target_n"), "memory_scope": scope(current, "memory"), "skills": scope(current, "skills"),
        "overall_train": current.get("overall"), "holdout": holdout.get("overall"), "holdout_memory": holdout.get("memory_target"), "code": scope(holdout, "code"), "code_train": scope(current, "code"),
    }


def ledger_row(label: str, target: str, now: dict, base: dict | None, when: str, verdict: str, note: str = "") -> str:
    share = lambda v: "—" if v is None else f"{v:.3f}"
    change = lambda k: "—" if base is None or now.get(k) is None or base.get(k) is None else f"{(now[k] - base[k]) * 100:+.1f}pp"
    cells = [label, target, *[share(now.get(k)) for k in ("memory", "overall_train", "holdout", "code")], change("memory"), change(TARGETS[target]), verdict, when + note]
    return "| " + " | ".join(cells) + " |\n"


def sweep(engine: Engine, folder: str, datasets: dict[str, str], label: str, target: str = "memory", top: int = 5, rerank: bool = False, note: str = "") -> dict:
    """A snapshot under a label, judged against the one called baseline, kept in folder with a row in its ledger."""
    os.makedirs(folder, exist_ok=True)
    place = lambda name: os.path.join(folder, name)
    base = None
    if os.path.exists(place("sweep-baseline.json")):
        with open(place("sweep-baseline.json")) as f:
            base = json.load(f)
    flags = {k: v for k, v in sorted(os.environ.items()) if k.startswith("RAG_")}
    now = snapshot(engine, datasets, top, rerank) | {"label": label, "target": target, "when": time.strftime("%Y-%m-%d %H:%M"), "flags": flags}
    now["verdict"], now["deltas"] = evaluate.decide(now, base, target, label == "baseline")
    with open(place(f"sweep-{label}.json"), "w") as f:
        json.dump(now, f, indent=1)
    ledger, shown = place("RESULTS.md"), " ".join(f"{k}={v}" for k, v in flags.items())
    head = "" if os.path.exists(ledger) else LEDGER_HEAD
    with open(ledger, "a") as f:
        f.write(head + ledger_row(label, target, now, base, now["when"], now["verdict"], (f" · {shown}" if shown else "") + (f" {note}" if note else "")))
    return now


def lint(engine: Engine, datasets: dict[str, str]) -> dict:
    """imperative: cases that are commands, by dataset; fixable, coverage_gap: stale labels; by_scope: counts of the fixable ones."""
    spark, chunks = engine.chunks.sparkSession, engine.chunks
    repos = [r[0] for r in chunks.filter("source_type = 'code' and repo is not null").select("repo").distinct().collect()]
    out = {"imperative": {}, "fixable": [], "coverage_gap": [], "by_scope": {}}
    for name, path in datasets.items():
        cases = numbered(spark, path)
        stale = evaluate.stale_labels(cases, chunks).withColumn("bucket", evaluate.bucket(F.col("scope"), F.col("expect"), repos)).persist()
        out["imperative"][name] = evaluate.imperative(cases).count()
        for r in stale.orderBy("query").collect():
            out[r["bucket"]].append((name, r["key"], r["query"], r["expect"]))
        for r in evaluate.fixable_by_scope(stale).collect():
            out["by_scope"][r["scope"]] = out["by_scope"].get(r["scope"], 0) + r["n"]
        stale.unpersist()
    return out


# ---- calibration

def calibrate(engine: Engine, dataset: str, top: int = 5) -> DataFrame:
    """rrf_k, weight, overall, code (hit@5), overall_pp, code_pp, star: settings of fusion, one changed at a time, against the usual ones.

    Each question is ranked once; all settings are weighed from its ranks. A star marks those that beat the usual ones anywhere.
    """
    spark = engine.chunks.sparkSession
    cases, frames = numbered(spark, dataset).collect(), None
    for c in cases:
        found = engine.ranks(c["query"], top, c["scope"], ["all"])
        hit = F.lit(False)
        for e in c["expect"]:
            hit = hit | F.col("path").contains(e)
        rows = found.select(F.lit(c["case_id"]).alias("case_id"), F.lit(c["key"]).alias("key"), "id", hit.alias("relevant"), "rank_cos", "rank_bm25", "named").toArrow()
        frames = rows if frames is None else pa.concat_tables([frames, rows])
    ranked = spark.createDataFrame(frames).persist()
    share = lambda part, name: evaluate.calibration(part, top).withColumnRenamed("hit5", name)
    both = share(ranked, "overall").join(share(ranked.filter("key = 'code'"), "code"), ["rrf_k", "weight"], "left").withColumn("code", F.coalesce("code", F.lit(0.0)))
    usual = both.filter("rrf_k = 60 and weight = 1.5").select(F.col("overall").alias("_o"), F.col("code").alias("_c"))
    gain = lambda now, was: F.round((F.col(now) - F.col(was)) * 100, 1)
    out = both.join(F.broadcast(usual), F.lit(True))  # one row
    return out.select("rrf_k", "weight", "overall", "code", gain("overall", "_o").alias("overall_pp"), gain("code", "_c").alias("code_pp"), ((F.col("overall") > F.col("_o") + 1e-9) | (F.col("code") > F.col("_c") + 1e-9)).alias("star"))


def floors(engine: Engine, dataset: str, top: int = 5) -> dict[str, tuple[float, float]]:
    """hit@5 overall and in code without reranking, and with the automatic choice."""
    out = {}
    for name, rerank in (("fusion", False), ("deployed", None)):
        r = run(engine, dataset, top, rerank, False, False)
        out[name] = (r["hit@5"], r["by_scope"].get("code", {}).get("hit@5", 0.0))
    return out


# ---- nightly

GOOD, BAD = 0x2ECC71, 0xE74C3C


def alert(url: str, title: str, text: str, good: bool) -> bool:
    """Posts a message to a webhook that takes embeds, if one is given; says whether it went through and never fails."""
    if not url:
        return False
    body = json.dumps({"embeds": [{"title": title, "description": text, "color": GOOD if good else BAD}]}).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10) as answer:
            return answer.status < 300
    except (OSError, ValueError):
        return False


def nightly(rebuild: Callable[[], int], engine: Engine, dataset: str | None, baseline: str | None, say: Callable[[str], None] = print) -> bool:
    """Rebuilds and then holds the result against a baseline, if there is one. False if either fails."""
    try:
        say(f"rebuilt: snapshot {rebuild()}")
    except Exception as e:
        say(f"rebuild failed: {(str(e) or type(e).__name__).splitlines()[0]}")
        return False
    if not (dataset and baseline and os.path.exists(baseline)):
        return True
    with open(baseline) as f:
        rows = compared(engine.chunks.sparkSession, run(engine, dataset), json.load(f))
    for r in rows:
        say(f"{r['metric']} {r['base']:.3f} {r['now']:.3f} {r['delta_pp']:+.1f}pp{'  regression' if r['failed'] else ''}")
    return not any(r["failed"] for r in rows)
