"""Definitions, calls and imports of source texts, and the call-graph tables made of them."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CALLS, DEFINITIONS, IMPORTS
from ..ship import ship, small_batches
from .chunking import NAME, closing_line, line_of

#: Fixed patterns of definitions, imports and calls.
DEFINITION = re.compile(
    rf"^([ \t]*)(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?"
    rf"(?:function\*?\s+({NAME})|class\s+({NAME})|(?:interface|type|enum)\s+({NAME})|(?:const|let|var)\s+({NAME})\s*[:=])",
    re.M,
)
IMPORT = re.compile(r"""^\s*import\s+(?:([^;'"]+?)\s+from\s+)?['"]([^'"]+)['"]""", re.M)
CALL = re.compile(rf"(?<![\w$])({NAME})\s*\(")
#: Words before a bracket that are no calls. Fixed values.
KEYWORDS = frozenset(
    "if for while switch catch return function class const let var import export typeof await async new do else try throw in of case delete void yield super this".split()
)
SHELL_DEFINITION = re.compile(r"^(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{", re.M)
FOUND = (
    "struct<defs:array<struct<name:string,language:string,start_line:int,end_line:int>>,calls:array<struct<caller:string,callee:string,line:int>>,"
    "imports:array<struct<module:string,name:string>>>"
)
MODULE = "<module>"


def of_python(text: str):
    defs, calls, imports = [], [], []
    try:
        stack = [(ast.parse(text), MODULE)]
    except (SyntaxError, ValueError, RecursionError):
        return defs, calls, imports
    while stack:  # depth first, children in order
        node, scope = stack.pop()
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                defs.append((node.name, "python", node.lineno, node.end_lineno or node.lineno))
                scope = node.name
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
                calls.append((scope, name, node.lineno))
            case ast.Import():
                imports += [(a.name, a.asname or a.name.rpartition(".")[2]) for a in node.names]
            case ast.ImportFrom():
                imports += [(node.module or "", a.name) for a in node.names]
        stack += [(child, scope) for child in reversed(list(ast.iter_child_nodes(node)))]
    return defs, calls, imports


def _inside(line: int, ranges) -> str:
    return next((name for name, first, last in ranges if first <= line <= last), MODULE)


def of_script(text: str, language: str):
    """TypeScript and JavaScript by patterns: unindented definitions, imports, and calls that aren't keywords or definitions."""
    found = [(line_of(text, m.start()), m.group(1), next(g for g in m.groups()[1:] if g)) for m in DEFINITION.finditer(text)]
    top = [(line, name) for line, indent, name in found if not indent]
    last = text.count("\n") + 1
    stops = [line - 1 for line, _ in top[1:]] + [last]
    ranges = [(name, line, max(line, stop)) for (line, name), stop in zip(top, stops, strict=False)]
    defs = [(name, language, first, end) for name, first, end in ranges]
    first_on_line: dict[int, set[str]] = {}
    for line, _, name in found:
        first_on_line.setdefault(line, set()).add(name)
    calls: dict[tuple[str, str, int], None] = {}
    for m in CALL.finditer(text):
        line = line_of(text, m.start())
        if m.group(1) not in KEYWORDS and m.group(1) not in first_on_line.get(line, ()):
            calls[(_inside(line, ranges), m.group(1), line)] = None
    imports = []
    for m in IMPORT.finditer(text):
        given = re.findall(NAME, m.group(1) or "") or [m.group(2).rpartition("/")[2]]
        imports += [(m.group(2), g) for g in given if g not in ("from", "as", "type", "default")]
    return defs, list(calls), imports


def of_shell(text: str):
    """Functions, and calls written name( to functions of the same text; a definition is written so too."""
    lines = text.splitlines()
    ranges = []
    for m in SHELL_DEFINITION.finditer(text):
        first = line_of(text, m.start())
        ranges.append((m.group(1), first, max(first, closing_line(lines, first))))
    if not ranges:
        return [], [], []
    own = "|".join(sorted({re.escape(r[0]) for r in ranges}, key=lambda x: (-len(x), x)))
    calls = {(_inside(line_of(text, m.start()), ranges), m.group(1), line_of(text, m.start())): None for m in re.finditer(rf"\b({own})\s*\(", text)}
    return [(name, "shell", first, last) for name, first, last in ranges], list(calls), []


def of_text(text: str | None, language: str | None):
    if text is None:
        return [], [], []
    if language == "python":
        return of_python(text)
    if language in ("typescript", "javascript"):
        return of_script(text, language)
    return of_shell(text) if language == "shell" else ([], [], [])


def extracted(files: DataFrame, text: Column, language: Column) -> DataFrame:
    """files with found: defs, calls and imports."""
    ship(files.sparkSession)
    small_batches(files.sparkSession)
    return files.withColumn("found", F.udf(of_text, FOUND, useArrow=True)(text, language))


def _first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the first, as an insert that ignores conflicts would keep."""
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct(*rows.columns), F.struct(order, *[c for c in rows.columns if c != order])).alias("_row")).select("_row.*")


def tables(found: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    """definitions, imports, calls of a frame with found; called_by is calls read from the callee."""
    base = found.select(F.col(path).alias("file"), "found")
    defs = base.select("file", F.posexplode("found.defs").alias("_o", "d")).select("_o", "file", F.col("d.name").alias("symbol_name"), "d.language", "d.start_line", "d.end_line")
    calls = base.select("file", F.posexplode("found.calls").alias("_o", "c")).select("_o", "file", "c.caller", "c.callee", F.col("c.line").alias("line_in_caller"))
    imports = base.select(F.col("file").alias("importing_file"), F.explode("found.imports").alias("i")).select("importing_file", F.col("i.module").alias("imported_module"), F.col("i.name").alias("imported_name"))
    calls = _first(calls, ["file", "caller", "callee"], "_o").drop("_o")
    return {
        "definitions": _first(defs, ["file", "symbol_name"], "_o").drop("_o"),
        "imports": imports.dropDuplicates(),
        "calls": calls,
        "called_by": calls.select("callee", "caller", "file", "line_in_caller"),
    }


def indexable(chunks: DataFrame) -> DataFrame:
    """Paths of Python code outside of installed packages."""
    path = F.col("path")
    out = chunks.filter((F.col("language") == "python") & F.col("source_type").isin("code", "workstation-code"))
    for part in ("/site-packages/", "/.venv", "/_vendor/"):
        out = out.filter(~path.contains(part))
    return out.select("path").distinct()


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """A table in which the rows of files are those of new."""
    gone = files.select(F.col("file").alias("_f")).distinct()
    return old.join(gone, F.col(column) == F.col("_f"), "left_anti").unionByName(new)


#: Stored tables by name: schema, and the column that names the file.
STORED = {"definitions": (DEFINITIONS, "file"), "imports": (IMPORTS, "importing_file"), "calls": (CALLS, "file")}


class SymbolStore:
    """The call graph's tables in a folder. A table is written beside the old one and then takes its place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        return self.spark.read.schema(STORED[name][0]).parquet(where) if self.fs.exists(self.path(where)) else self.spark.createDataFrame([], STORED[name][0])

    def _write(self, name: str, rows: DataFrame) -> int:
        where, new = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/_new-{name}")
        rows.write.mode("overwrite").parquet(new.toString())
        self.fs.delete(where, True)
        self.fs.rename(new, where)
        return self.read(name).count()

    def rebuild(self, made: dict[str, DataFrame]) -> dict[str, int]:
        """All tables anew; their counts of rows."""
        return {name: self._write(name, made[name]) for name in STORED}

    def replace(self, made: dict[str, DataFrame], files: DataFrame) -> dict[str, int]:
        """The rows of some files anew; all others stay."""
        return {name: self._write(name, replace_files(self.read(name), made[name], files, column)) for name, (_, column) in STORED.items()}

    def views(self) -> None:
        """Temporary views symbols_definitions, _imports, _calls_to and, over the last, symbols_called_by: nothing is copied."""
        for name, view in (("definitions", "definitions"), ("imports", "imports"), ("calls", "calls_to")):
            self.read(name).createOrReplaceTempView(f"symbols_{view}")
        self.spark.table("symbols_calls_to").select("callee", "caller", "file", "line_in_caller").createOrReplaceTempView("symbols_called_by")
