"""Context packs under a token budget."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens
from .diffs import callers, test_files, touched_symbols
from .search import Engine

LOW_BUDGET = 100


#: Parts that a group is dealt to before its rows meet.
PARTS = 64


def within_budget(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows of each group up to the first that doesn't fit: what comes after it goes too, however small.

    A row's sum within a part of its group is no more than its sum within the group, so the parts are cut at the budget first and a group's
    task gets PARTS times what fits, however large the group is. Costs are 1 or more.
    """
    upto = lambda *by: F.sum(cost).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(PARTS))).withColumn("running", upto(group, "_part")).filter(F.col("running") <= budget + F.col(cost)).drop("_part")
    return few.withColumn("running", upto(group)).filter(F.col("running") <= budget)


def greedy_budget(costs: Column, budget: int) -> Column:
    """Positions (from 0) of an ordered array of costs that are taken if one that doesn't fit is skipped."""
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"), F.lit(budget).cast("long").alias("left"))

    def step(s: Column, c: Column) -> Column:
        fits = s["left"] >= c
        return F.struct(
            F.when(fits, F.concat(s["taken"], F.array(s["at"]))).otherwise(s["taken"]).alias("taken"), (s["at"] + 1).alias("at"), F.when(fits, s["left"] - c).otherwise(s["left"]).alias("left")
        )

    return F.aggregate(costs, start, step, lambda s: s["taken"])


def cost_of(block: str) -> int:
    return max(1, len(block) // 4)


def _title(hit, scores: bool) -> str:
    repo = f"/{hit['repo']}" if hit["repo"] else ""
    symbol = f"::{hit['symbol']}" if hit["symbol"] else ""
    gap, tail = ("  ", f"  (cos={hit['cos']} bm={hit['bm25']})") if scores else (" ", "")
    return f"### {hit['source_type']}{repo}{symbol}{gap}`{hit['path']}:{hit['start_line']}-{hit['end_line']}`{tail}"


def _block(title: str, text: str) -> str:
    return f"{title}\n```\n{text}\n```\n"


class Pack:
    """Blocks as text, and what is left of the budget. The hits of a section are a few rows."""

    def __init__(self, budget: int):
        self.budget, self.left, self.out = budget, budget, []

    def add(self, block: str) -> bool:
        if cost_of(block) > self.left:
            return False
        self.out.append(block)
        self.left -= cost_of(block)
        return True

    def section(self, name: str, hits: list, cap: int) -> None:
        """Ends at the first block that doesn't fit."""
        if hits:
            self.out.append(f"## {name}")
            if all(self.add(_block(_title(h, True), h["text"][:cap])) for h in hits):
                self.out.append("")

    def text(self, header: str, left: int | None = None) -> str:
        if not self.out:
            return "(no relevant context found)"
        return f"{header}\n_Budget: {self.budget} tokens · remaining ≈ {self.left if left is None else left}_\n\n" + "\n".join(self.out)


def task_pack(engine: Engine, task: str, files: list[str] = (), budget: int = 4000, cwd: str | None = None) -> str:
    """Code, standards and past decisions for a task, then named files."""
    pack = Pack(budget)
    pack.section("Relevant code", engine.search(task, 6, ["code"], cwd=cwd).collect(), 900)
    pack.section("Applicable standards", engine.search(task, 3, ["standards"], ["all"], cwd=cwd).collect(), 600)
    pack.section("Past decisions / memory", engine.search(task, 4, ["memory", "plans", "handoffs"], ["all"], cwd=cwd).collect(), 700)
    if files:
        pack.out.append("## Explicit files")
        found = engine.search(task, 2, ["code"], ["all"], cwd=cwd).collect()
        for name in files:
            path = Path(name).expanduser().resolve()
            own = [h for h in found if h["path"] == str(path)]
            if not own and path.is_file():
                pack.add(_block(f"### {path.name}  `{path}:1-40`", "\n".join(path.read_text(errors="replace").splitlines()[:40])))
            for h in own:
                if not pack.add(_block(f"### {h['path']}:{h['start_line']}-{h['end_line']}", h["text"][:900])):
                    break
        pack.out.append("")
    return pack.text(f"# Context pack for: {task}")


def file_hits(engine: Engine, paths: list[str], query: str, budget: int) -> tuple[list, int]:
    """Hits of a search for each file that lie in it, as far as the budget goes; it ends when little is left."""
    out = []
    for path in paths:
        for h in engine.search(f"{query} {path}" if query else path, 3).collect():
            if path in h["path"]:
                cost = max(1, min(len(h["text"]), min(900, budget // 4)) // 4)
                if cost > budget:
                    break
                out.append(h)
                budget -= cost
        if budget <= LOW_BUDGET:
            break
    return out, budget


def diff_pack(engine: Engine, changes: DataFrame, definitions: DataFrame, called_by: DataFrame, query: str = "", budget: int = 3000, strict_compat: bool = False) -> str:
    """Sections for the symbols that a diff touches, their callers and tests, and standards. Files in order of their paths."""
    if changes.isEmpty():
        return "(no changes detected)"
    symbols = touched_symbols(changes, definitions).persist()
    pack = Pack(budget)

    def section(name: str, paths: list[str], asked: str, cap: int) -> None:
        if not paths or pack.left <= LOW_BUDGET:
            return
        pack.out.append(f"## {name}\n")
        found, pack.left = file_hits(engine, paths, asked, pack.left)
        pack.out += [_block(_title(h, False), h["text"][:cap]) for h in found]

    listed = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())
    section("Modified symbols", listed(symbols, "file"), query or "implementation", 900)
    calling = callers(symbols, called_by, strict_compat)
    section("Callers (1-hop)", listed(calling, "caller" if strict_compat else "file"), query or "caller context", 800)
    section("Tests", listed(test_files(symbols, engine.chunks), "path"), query or "test", 700)
    if query and pack.left > LOW_BUDGET:
        pack.out.append("## Applicable standards\n")
        for h in engine.search(query, 2, ["standards"]).collect():  # what doesn't fit is skipped
            pack.add(_block(f"### `{h['path']}:{h['start_line']}-{h['end_line']}`", h["text"][:600]))
    symbols.unpersist()
    return pack.text("# Diff-scoped context pack", max(0, pack.left))
