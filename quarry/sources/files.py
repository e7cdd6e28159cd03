"""File, commit, transcript and case sources."""

from __future__ import annotations

import glob
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import paths
from ..functions import text as T
from ..ship import ship

LOG_DAYS, LOG_SECONDS, COMMIT_LINES, BODY_CHARS, COMMIT_CHARS = 180, 30, 6, 1200, 4000
SKIPPED_SESSIONS = ("acompact-", "agent-acompact-")
FILE_COLUMNS = "source_type string, ordinal int, path string, real string"


def derived_sources(settings: Settings) -> list[tuple[str, str]]:
    """Configured sources, then those of each repo. Specs and the roadmap come before the docs that also hold them."""
    out = list(settings.sources)
    for r in settings.repos:
        if os.path.isdir(r):
            for kind, place in (("changelog", "CHANGELOG.md"), ("spec", "docs/specs/**/*.md"), ("roadmap", "docs/roadmap.md"), ("repo-docs", "docs/**/*.md"), ("repo-readme", "README.md"), ("serena", ".serena/memories/*.md")):
                out.append((kind, f"{r}/{place}"))
    out += [("workstation-code", g) for g in settings.code_globs]
    for r in settings.repos:
        if os.path.isdir(f"{r}/graphify-out"):
            out += [("graph", f"{r}/graphify-out/GRAPH_REPORT.md"), ("graph", f"{r}/graphify-out/wiki/*.md")]
    return out


def graphed_repos(settings: Settings) -> list[str]:
    return [r for r in settings.repos if os.path.exists(f"{r}/graphify-out/graph.json")]


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with one key the first in order: a least row is kept a key, and no key's rows are gathered."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).select("_row.*")


def note_files(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """source_type, path of the files of each glob; a file that several globs give (links resolved) has the first one's type."""
    rows = [(kind, k, p, os.path.realpath(p)) for k, (kind, g) in enumerate(sources) for p in sorted(glob.glob(os.path.expanduser(g), recursive=True, include_hidden=True)) if os.path.isfile(p)]
    found = first_wins(spark.createDataFrame(rows, FILE_COLUMNS), "real", ["ordinal", "path"])
    return found.filter(~paths.is_quarantined(F.col("path"))).select("source_type", "path")


CONTENTS, READ_BYTES = "path string, content binary, mtime double", 16 << 20


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some files at a time, as many as READ_BYTES hold."""
    rows, size = [], 0
    for frame in frames:
        for path in frame["path"]:
            try:
                with open(path, "rb") as f:
                    rows.append((path, f.read(), os.stat(path).st_mtime))
                size += len(rows[-1][1])
            except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                continue
            except OSError:
                rows.append((path, None, None))
            if size >= READ_BYTES:
                yield pd.DataFrame(rows, columns=["path", "content", "mtime"])
                rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["path", "content", "mtime"])


def read_contents(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """path, content (null if unreadable), mtime of the listed files that are there, read by the executors; no list passes the driver.

    Files are on a file system that all executors mount, as the index's own paths are.
    """
    ship(spark)
    return listed.select("path").mapInPandas(_read, CONTENTS)


def read_texts(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """listed (source_type, path) with text, file_sha and mtime; unreadable bytes are replaced, unreadable files left out."""
    found = read_contents(spark, listed.select("path").distinct()).filter("content is not null")
    read = found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha1("content").alias("file_sha"), "mtime")
    return listed.join(read, "path")


def code_files(spark: SparkSession, settings: Settings) -> DataFrame:
    """source_type, path of the code files of the repos that have no graph: by extension and size, outside of excluded folders."""
    graphed = set(graphed_repos(settings))
    out = None
    for r in settings.repos:
        if r in graphed or not os.path.isdir(r):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{os.path.realpath(r)}").select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")
        inner = F.substring("path", len(os.path.realpath(r)) + 2, 10_000)
        kept = found.filter((F.col("length") <= paths.MAX_FILE_BYTES) & paths.extension(F.col("path")).isin(list(paths.CODE_EXTENSIONS)) & ~paths.is_excluded(inner))
        kept = kept.select(F.lit("code").alias("source_type"), "path")
        out = kept if out is None else out.unionByName(kept)
    return spark.createDataFrame([], "source_type string, path string") if out is None else out


def commit_log(repo: str) -> list[str]:
    """Commits of LOG_DAYS, fields parted by \\x01 and commits by \\x02; none if git fails or takes too long."""
    try:
        done = subprocess.run(
            ["git", "-C", repo, "log", f"--since={LOG_DAYS}.days", "--no-merges", "--format=%H%x01%ad%x01%an%x01%s%x01%b%x02"], capture_output=True, text=True, timeout=LOG_SECONDS, check=True
        )
    except (subprocess.SubprocessError, OSError):
        return []
    return [x.strip("\n") for x in done.stdout.split("\x02") if x.strip()]


def commit_chunks(logs: DataFrame) -> DataFrame:
    """logs (repo, entry) -> a chunk for each commit: subject, then the first lines of its body."""
    f = F.split("entry", "\x01", 5)
    part = lambda k: F.coalesce(F.get(f, F.lit(k)), F.lit(""))
    kept = F.filter(F.split(part(4), "\n"), lambda x: F.trim(x) != "")
    body = F.left(F.array_join(F.slice(kept, 1, COMMIT_LINES), "\n"), F.lit(BODY_CHARS))
    text = F.left(F.when(body == "", part(3)).otherwise(F.concat(part(3), F.lit("\n\n"), body)), F.lit(COMMIT_CHARS))
    sha = part(0)
    return logs.filter(F.length(sha) > 0).select(
        F.lit("commit").alias("source_type"), "repo", F.lit(None).cast("string").alias("language"), F.left(sha, F.lit(7)).alias("symbol"),
        F.concat(F.lit("git:"), "repo", F.lit("@"), sha).alias("path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), text.alias("text"), sha.alias("file_sha"), F.lit(0.0).alias("mtime"),
    )


def commits(spark: SparkSession, settings: Settings) -> DataFrame:
    rows = [(os.path.basename(r), e) for r in settings.repos for e in commit_log(r)]
    return commit_chunks(spark.createDataFrame(rows, "repo string, entry string"))


def message_text(line: Column) -> Column:
    """Text of a transcript line: a string, or the text, tool and result blocks of a list; up to the first system reminder."""
    v = F.try_parse_json(line)
    get = lambda p, t: F.try_variant_get(v, p, t)
    plain = get("$.message.content", "string")
    blocks = get("$.message.content", "array<variant>")

    def block(b: Column) -> Column:
        g = lambda p: F.try_variant_get(b, p, "string")
        results = F.try_variant_get(b, "$.content", "array<variant>")
        joined = F.array_join(F.transform(results, lambda r: F.coalesce(F.try_variant_get(r, "$.text", "string"), F.when(F.schema_of_variant(r).startswith("OBJECT"), "").otherwise(F.try_variant_get(r, "$", "string")))), " ")
        kind = g("$.type")
        return (
            F.when(kind == "text", g("$.text"))
            .when(kind == "tool_use", F.concat(F.lit("[Tool: "), F.coalesce(g("$.name"), F.lit("")), F.lit("] "), F.left(F.coalesce(F.to_json(F.try_variant_get(b, "$.input", "variant")), F.lit("{}")), F.lit(500))))
            .when(kind == "tool_result", F.concat(F.lit("[Result] "), F.left(F.coalesce(F.when(results.isNotNull(), joined), g("$.content"), F.lit("")), F.lit(1000))))
        )

    listed = F.array_join(F.filter(F.transform(blocks, block), lambda t: t.isNotNull() & (t != "")), "\n")
    cut = F.regexp_replace(F.split(listed, "<system-reminder>", 2)[0], "^\\s+|\\s+$", "")
    # a JSON list also casts to a string, so the list goes first
    return F.coalesce(F.when(blocks.isNotNull(), cut), plain, F.lit(""))


def transcripts(spark: SparkSession, folder: str, days: int = 30, now: float | None = None) -> DataFrame:
    """path, line_no, text, mtime of the messages of transcripts changed in the last days."""
    rows = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("wholetext", "true").load(folder)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").cast("double").alias("mtime"))
    name = T.file_name(F.col("path"))
    for part in SKIPPED_SESSIONS:
        rows = rows.filter(~name.contains(part))
    start = (F.lit(now) if now is not None else F.unix_timestamp().cast("double")) - days * 86400
    rows = rows.filter(F.col("mtime") >= start).select("path", "mtime", F.posexplode(T.lines(F.col("value"))).alias("line_no", "line"))
    return rows.filter(F.trim("line") != "").select("path", "mtime", "line_no", message_text(F.col("line")).alias("text")).filter("text <> ''")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """query, expect, scope of a JSON-lines dataset; expect and scope may be a string or a list there. Lines without a label go."""
    v = F.try_parse_json("value")
    either = lambda p: F.coalesce(F.try_variant_get(v, p, "array<string>"), F.array(F.try_variant_get(v, p, "string")))
    rows = spark.read.text(path).filter(F.trim("value") != "")
    rows = rows.select(F.try_variant_get(v, "$.query", "string").alias("query"), either("$.expect_path_contains").alias("expect"), F.filter(either("$.expect_scope"), lambda s: s.isNotNull()).alias("scope"))
    rows = rows.withColumn("scope", F.when(F.size("scope") > 0, F.col("scope")))
    return rows.filter(F.get("expect", F.lit(0)).isNotNull())


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("diff"))


def whole_files(sizes: DataFrame) -> DataFrame:
    """Changes that take all lines of files (file, n: number of lines) as added."""
    return sizes.select("file", F.lit(1).alias("old_start"), F.lit(1).alias("new_start"), F.sequence(F.lit(1), F.greatest("n", F.lit(1))).alias("added_lines"))


def named_files(spark: SparkSession, sizes: list[tuple[str, int]]) -> DataFrame:
    return whole_files(spark.createDataFrame(sizes, "file string, n int"))


def git_changed(repo: str) -> list[str]:
    try:
        done = subprocess.run(["git", "-C", repo, "diff", "--name-only"], capture_output=True, text=True, timeout=LOG_SECONDS, check=True)
    except (subprocess.SubprocessError, OSError):
        return []
    return [f"{repo}/{x}" for x in done.stdout.split("\n") if x]


def pull_request_diff(number: int) -> str:
    try:
        return subprocess.run(["gh", "pr", "diff", str(number)], capture_output=True, text=True, check=True).stdout
    except (subprocess.SubprocessError, OSError):
        return ""
