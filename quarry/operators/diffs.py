"""Diff-scoped retrieval: changed lines, the symbols they touch, callers and tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..ship import ship, small_batches

HUNK = re.compile(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
CHANGES = "array<struct<path:string,old_start:int,new_start:int,added_lines:array<int>>>"


def parse(text: str | None, strict_compat: bool = False) -> list[tuple[str, int, int, list[int]]]:
    """Files of a unified diff with their added lines, in order.

    strict_compat keeps two habits of older packs: a file has the lines of its last hunk only, and removed lines advance the count.
    """
    out: dict[str, list] = {}
    now, line_no = None, 0
    for line in (text or "").splitlines():
        if line.startswith("diff --git") or line.startswith("--- a/") or line.startswith("--- /dev/null"):
            now = None
        elif line.startswith("+++ b/"):
            now = out[line[6:]] = [0, 0, []]
        elif now is None:
            continue
        elif m := HUNK.match(line):
            first = not now[1]
            if strict_compat or first:
                now[0], now[1] = int(m.group(1)), int(m.group(2))
            if strict_compat:
                now[2] = []
            line_no = int(m.group(2)) - 1
        elif line.startswith("+") and not line.startswith("+++"):
            line_no += 1
            now[2].append(line_no)
        elif line.startswith("-") and not line.startswith("---"):
            line_no += strict_compat
        elif not line.startswith(("\\", "@@")) and (line or not strict_compat):
            line_no += 1
    return [(path, old, new, sorted(set(lines))) for path, (old, new, lines) in out.items()]


def parsed(diffs: DataFrame, text: Column, strict_compat: bool = False) -> DataFrame:
    """diffs with a row for each changed file: file, old_start, new_start, added_lines."""
    ship(diffs.sparkSession)
    small_batches(diffs.sparkSession)
    rows = diffs.select("*", F.explode(F.udf(lambda t: parse(t, strict_compat), CHANGES, useArrow=True)(text)).alias("_c"))
    return rows.select(*diffs.columns, F.col("_c.path").alias("file"), "_c.old_start", "_c.new_start", "_c.added_lines")


def touched_symbols(changes: DataFrame, definitions: DataFrame) -> DataFrame:
    """changes (file, added_lines) with symbol_name and symbol_id of definitions that meet the span of added lines.

    The file is an equi-join key; the span is a condition beside it.
    """
    span = changes.filter(F.size("added_lines") > 0).select(*[F.col(c) for c in changes.columns], F.array_min("added_lines").alias("_low"), F.array_max("added_lines").alias("_high"))
    defs = definitions.select(F.col("file").alias("_f"), "symbol_name", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    met = span.join(defs, (F.col("file") == F.col("_f")) & (F.col("_s") <= F.col("_high")) & (F.col("_e") >= F.col("_low")))
    return met.withColumn("symbol_id", F.concat_ws("::", "file", "symbol_name")).drop("_f", "_s", "_e", "_low", "_high").dropDuplicates(["symbol_id"])


def bare_name(symbol_id: Column) -> Column:
    return F.element_at(F.split(symbol_id, "::"), -1)


def callers(symbols: DataFrame, called_by: DataFrame, strict_compat: bool = False) -> DataFrame:
    """symbol_id, caller, file: direct callers of symbols (symbol_id). A callee is a bare name, a whole id, or ends in .name.

    Each way is an equi-join on a key made of the callee; strict_compat leaves out bare names, which is how callees are stored.
    """
    calls = called_by.select("callee", "caller", "file")
    last = F.regexp_extract("callee", "\\.([^.]*)$", 1)
    keys = F.array(F.struct(F.lit("id").alias("k"), F.col("callee").alias("v")), F.struct(F.lit("dot").alias("k"), F.when(F.col("callee").contains("."), last).alias("v")), F.struct(F.lit("bare").alias("k"), F.col("callee").alias("v")))
    calls = calls.select("caller", "file", F.explode(keys).alias("_k")).filter("_k.v is not null")
    name = bare_name(F.col("symbol_id"))
    asked = F.array(F.struct(F.lit("id").alias("k"), F.col("symbol_id").alias("v")), F.struct(F.lit("dot").alias("k"), name.alias("v")), F.struct(F.lit("bare").alias("k"), name.alias("v")))
    asked = symbols.select("symbol_id", F.explode(asked).alias("_k"))
    asked = asked.filter(F.col("_k.k") != "bare") if strict_compat else asked
    return asked.join(calls, "_k").select("symbol_id", "caller", "file").distinct()


def test_files(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Paths of test chunks that name a symbol, by LIKE: any letter case, and _ and % in a name match anything.

    symbols are those of one diff, a small driver-sized list by the contract of a diff; the chunks are scanned once.
    """
    names = [r[0] for r in symbols.select(bare_name(F.col("symbol_id")).alias("n")).distinct().orderBy("n").collect()]
    named = F.lit(False)
    for n in names:
        named = named | F.col("text").ilike(f"%{n}%")
    return chunks.filter(paths.is_test_path(F.col("path")) & named).select("path").distinct().orderBy("path")
