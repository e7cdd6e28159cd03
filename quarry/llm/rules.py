"""Quality rules: a base rule and a decision list that is learned from labels by sequential covering.

Thresholds are quantiles of the labelled rows. Of two thirds of them a rule is grown, condition by condition, each the one with
the most information gain over the rows that the rule still covers; of the last third it is pruned: conditions at its end go if
the rule is better without. Rows that a rule covers leave, and the next rule is grown, until none is precise enough or the list
has as many rules as a reader can take in (most_rules, of most_conditions each: parameters of the model). Every step is one aggregation over all labelled rows, of a few hundred counts; nothing is sampled. The result is an ordered when().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, release, text_hashes
from .textstats import FEATURES, features, text_counts

BINS, MOST_RULES, MOST_CONDITIONS, PRECISION, LEAST_COVER = 32, 8, 3, 0.9, 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def expr(self) -> Column:
        x = F.col(self.feature)
        return x >= self.limit if self.above else x < self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.limit:.6g}"


def _gain(p: float, n: float, was: float) -> float:
    return p * (math.log2(p / (p + n)) - was) if p else 0.0


def learn_rules(labelled: DataFrame, names: tuple[str, ...] = FEATURES, precision: float = PRECISION, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS) -> list[list[Condition]]:
    """Rules for label 1 (reject). labelled: a double column for each name, label int, fold int (0 or 1 grows, 2 prunes).

    At most most_rules rules of most_conditions conditions. Of conditions with equal gain the first feature's lowest limit is taken, above
    it before below. Without rows, or with one label only, there are no rules.
    """
    marks = [k / BINS for k in range(1, BINS)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    limits = labelled.agg(*[F.percentile_approx(n, sorted(marks), 10_000).alias(n) for n in names]).first()
    quantiles = {n: sorted(set(limits[n] or [])) for n in names}
    # halfway between neighbours too: where most rows have one value, a limit beside it parts them from the rest
    edges = {n: sorted({*q, *((a + b) / 2 for a, b in zip(q, q[1:], strict=False))}) for n, q in quantiles.items()}
    binned = lambda n: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[n]]) if edges[n] else F.array().cast("array<double>"), lambda e: e <= F.col(n)))
    rows = materialize(labelled.select("label", "fold", F.array(*[binned(n) for n in names]).alias("bins")), "binned")
    picks: list[list[tuple[int, bool, int]]] = []
    holds = lambda c: F.col("bins")[c[0]] >= c[2] if c[1] else F.col("bins")[c[0]] < c[2]

    def all_hold(conditions) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & holds(c)
        return out

    while len(picks) < most_rules:
        left = rows
        for rule in picks:
            left = left.filter(~all_hold(rule))
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < most_conditions:
            found = left.filter("fold < 2").filter(all_hold(rule)).select("label", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("label").alias("p"), F.count("*").alias("t")).collect()
            counts = {(r["f"], r["b"]): (r["p"], r["t"] - r["p"]) for r in found}
            all_p, all_n = sum(p for (f, _), (p, _) in counts.items() if f == 0), sum(n for (f, _), (_, n) in counts.items() if f == 0)
            if not all_p or not all_n:
                break
            was, best = math.log2(all_p / (all_p + all_n)), (0.0, None)
            for f, name in enumerate(names):
                low_p = low_n = 0
                for b in range(1, len(edges[name]) + 1):
                    p, n = counts.get((f, b - 1), (0, 0))
                    low_p, low_n = low_p + p, low_n + n
                    for above, cp, cn in ((True, all_p - low_p, all_n - low_n), (False, low_p, low_n)):
                        if cp >= LEAST_COVER and (g := _gain(cp, cn, was)) > best[0] + 1e-9:
                            best = (g, (f, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        sums = [F.coalesce(F.sum(F.when(all_hold(rule[:k]), v)), F.lit(0)) for k in range(1, len(rule) + 1) for v in (F.col("label"), 1 - F.col("label"))]
        got = left.filter("fold = 2").agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        worth = [((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k) for k in range(len(rule))]
        k = -max(worth)[1]
        if got[2 * k] < 1 or got[2 * k] < precision * (got[2 * k] + got[2 * k + 1]):
            break
        picks.append(rule[: k + 1])
    release(rows)
    return [[Condition(names[f], above, edges[names[f]][b - 1]) for f, above, b in rule] for rule in picks]


def decision(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds (from 1), else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule[0].expr()
        for c in rule[1:]:
            holds = holds & c.expr()
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _judged(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """Of each row doc_id, the hashes of its text, the counts, base_failed, rule and kept."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("*", *text_hashes(F.col("text")))
    counted = text_counts(text, ["doc_id", "h1", "h2"])
    counted = materialize(counted.select("*", *[c.alias(n) for n, c in features().items()]), "counts")
    rules: list[list[Condition]] = []
    if labels is not None:
        marked = labels.select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("label")).filter("label in (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
        known = counted.join(marked, F.col("doc_id") == F.col("_id")).select(*FEATURES, F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"))
        known = materialize(known, "labelled")
        rules = learn_rules(known)
        release(known)
    out = counted.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the contract's counts, base_failed, kept, rule (the first learned rule that holds, or 0).

    labels: doc_id, quality (0 is to be rejected); rows with null quality or unknown doc_id count for nothing, of several labels of
    one doc_id the worst counts once, and without labels only the base rule holds. Null and empty texts fail the base rule. A very
    long text is counted whole, as one row of its words. Rows that repeat a doc_id are judged one by one, and each teaches if the
    doc_id has a label. Of conditions with equal gain the first feature's lowest limit is taken. An empty table gives no rows.
    Other columns of docs are ignored.
    """
    return _judged(docs, labels, id_col, text_col).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_good(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge keeps, each by its own text; repeated rows all stay or all go."""
    kept = _judged(docs, labels, id_col, text_col).filter("kept").select("doc_id", "h1", "h2", F.lit(False).alias("once")).distinct()
    return keep_rows(docs, id_col, text_hashes(F.col(text_col)), kept)
