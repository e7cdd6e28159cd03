"""Ranking quality: hits, metrics, the regression gate, decisions, lints and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

METRICS = ("mrr", "hit1", "hit3", "hit5")
TOLERANCE_PP, MEMORY_GUARD, TARGET_GAIN, MEMORY_GOAL = 5.0, -0.005, 0.01, 0.75
RRF_KS, WEIGHTS = (20, 40, 60, 80, 100, 150), (1.0, 1.25, 1.5, 2.0, 2.5, 3.0)


def hit_ranks(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases (case_id, expect, scope) with hit_rank: the best rank of a result (case_id, rank, path) that holds an expected part."""
    met = cases.join(results, "case_id").filter(F.exists("expect", lambda e: F.col("path").contains(e)))
    return cases.join(met.groupBy("case_id").agg(F.min("rank").alias("hit_rank")), "case_id", "left")


def metrics_of(hit_rank: Column) -> list[Column]:
    within = lambda k: F.round(F.avg(F.when(hit_rank <= k, 1.0).otherwise(0.0)), 3).alias(f"hit{k}")
    return [F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / hit_rank, F.lit(0.0))), 3).alias("mrr"), within(1), within(3), within(5)]


def metrics(ranked: DataFrame) -> DataFrame:
    """scope, n, mrr, hit1, hit3, hit5 for each scope key and, with scope null, overall: one aggregation over grouping sets."""
    keyed = ranked.withColumn("scope", paths.scope_key(F.col("scope"))) if dict(ranked.dtypes)["scope"] != "string" else ranked
    return keyed.rollup("scope").agg(*metrics_of(F.col("hit_rank")))


def memory_hit5(ranked: DataFrame) -> DataFrame:
    """n and hit5 of the cases that aim at memory notes."""
    return ranked.filter(paths.memory_target(paths.scope_key(F.col("scope")), F.col("expect"))).agg(F.count("*").alias("n"), F.avg(F.when(F.col("hit_rank") <= 5, 1.0).otherwise(0.0)).alias("hit5"))


def gate(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE_PP) -> DataFrame:
    """metric, base, now, delta_pp, failed of two frames (metric, value)."""
    both = baseline.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("now")), "metric")
    delta = F.round((F.col("now") - F.col("base")) * 100, 6)
    return both.select("metric", "base", "now", delta.alias("delta_pp"), (delta < -tolerance).alias("failed"))


def decide(now: dict, base: dict | None, target: str, is_baseline: bool = False) -> tuple[str, dict]:
    """KEEP if memory doesn't fall, here and on the holdout, and the target gains; with the deltas."""
    out = {"mem_delta": None, "holdout_mem_delta": None, "target_delta": None}
    if is_baseline:
        return "BASELINE", out
    if base is None:
        return "NO-BASE", out
    key = {"overall": "holdout"}.get(target, target)
    change = lambda k: (now.get(k) or 0) - (base.get(k) or 0)
    out["mem_delta"], out["holdout_mem_delta"] = change("memory"), change("holdout_memory")
    if now.get(key) is not None and base.get(key) is not None:
        out["target_delta"] = now[key] - base[key]
    safe = min(out["mem_delta"], out["holdout_mem_delta"]) >= MEMORY_GUARD
    return ("KEEP" if safe and out["target_delta"] is not None and out["target_delta"] >= TARGET_GAIN else "REVERT"), out


def decisions(runs: DataFrame) -> DataFrame:
    """runs (label, memory, base_memory, holdout_memory, base_holdout_memory, target, base_target) with verdict."""
    safe = (F.col("memory") - F.col("base_memory") >= MEMORY_GUARD) & (F.col("holdout_memory") - F.col("base_holdout_memory") >= MEMORY_GUARD)
    gain = F.coalesce(F.col("target") - F.col("base_target") >= TARGET_GAIN, F.lit(False))
    return runs.withColumn("verdict", F.when(safe & gain, "KEEP").otherwise("REVERT"))


#: Expected parts that are matched with paths at once.
LABELS_AT_ONCE = 1000


def stale_labels(cases: DataFrame, indexed: DataFrame) -> DataFrame:
    """Cases (case_id, expect) of which no expected part is in any indexed path. Labels, written by hand, are matched in blocks."""
    parts = sorted(r[0] for r in cases.select(F.explode("expect").alias("_e")).distinct().collect())
    known, found = indexed.select("path").distinct(), []
    for low in range(0, len(parts), LABELS_AT_ONCE):
        block = F.array(*[F.lit(x) for x in parts[low : low + LABELS_AT_ONCE]])
        found += [r[0] for r in known.select(F.explode(F.filter(block, lambda e: F.col("path").contains(e))).alias("_e")).distinct().collect()]
    met = cases.select("case_id", F.explode("expect").alias("_e")).filter(F.col("_e").isin(found)).select("case_id").distinct()
    return cases.join(met, "case_id", "left_anti")


def bucket(scope: Column, expect: Column, code_repos: list[str] | None = None) -> Column:
    """fixable, or coverage_gap for code labels that name no repo with indexed code."""
    named = F.exists(expect, lambda e: F.exists(F.array(*[F.lit(r) for r in code_repos]), lambda r: e.contains(r))) if code_repos else F.lit(False)
    return F.when((paths.scope_key(scope) == "code") & ~named, "coverage_gap").otherwise("fixable")


def fixable_by_scope(stale: DataFrame) -> DataFrame:
    return stale.filter(F.col("bucket") == "fixable").groupBy(paths.scope_key(F.col("scope")).alias("scope")).agg(F.count("*").alias("n"))


def imperative(cases: DataFrame) -> DataFrame:
    return cases.filter(paths.is_command(F.col("query")))


def grid() -> list[tuple[int, float]]:
    """rrf_k and weight of each setting: one factor at a time."""
    return [(k, 1.5) for k in RRF_KS] + [(60, w) for w in WEIGHTS if w != 1.5]


def reach(top: int = 5) -> int:
    """Rows behind so many in both rankings are in no setting's top: the top of the weightier ranking alone is ahead of them."""
    return max(next(n for n in range(top, 10**6) if (1 + w) / (k + n + 1) < max(1.0, w) / (k + top) - 1e-9) for k, w in grid())


def calibration(ranked: DataFrame, top: int = 5) -> DataFrame:
    """rrf_k, weight, hit5: shares of cases whose relevant row is in the top after fusion, for one factor at a time.

    ranked: case_id, id, rank_cos, rank_bm25, relevant and, if known, named (gets the symbol boost). The few settings are an array that
    each row is exploded by: one job.
    """
    settings = F.explode(F.array(*[F.struct(F.lit(k).alias("rrf_k"), F.lit(w).alias("weight")) for k, w in grid()]))
    named = F.col("named") if "named" in ranked.columns else F.lit(False)
    each = ranked.withColumn("_s", settings).select("case_id", "id", "relevant", "_s.rrf_k", "_s.weight", "rank_cos", "rank_bm25", named.alias("named"))
    each = each.withColumn("score", F.round(F.when(F.col("named"), 1.0 / (F.col("rrf_k") + 1)).otherwise(0.0) + F.coalesce(1.0 / (F.col("rrf_k") + F.col("rank_cos")), F.lit(0.0)) + F.coalesce(F.col("weight") / (F.col("rrf_k") + F.col("rank_bm25")), F.lit(0.0)), 12))
    place = F.row_number().over(Window.partitionBy("rrf_k", "weight", "case_id").orderBy(F.desc("score"), "id"))
    hit = each.withColumn("place", place).groupBy("rrf_k", "weight", "case_id").agg(F.max(F.when(F.col("relevant") & (F.col("place") <= top), 1.0).otherwise(0.0)).alias("hit"))
    return hit.groupBy("rrf_k", "weight").agg(F.round(F.avg("hit"), 6).alias("hit5"))
