"""Query log and the observability report."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import QUERIES

DAYS, LOW_SCORE = 7, 0.25


def log_query(spark: SparkSession, path: str, hits: list, query: str, types, repos, cwd: str, rerank: bool, on: bool = False, now: float | None = None) -> bool:
    """Appends a row; never fails. Blank queries and empty corpora aren't logged."""
    if not on or not query.strip():
        return False
    joined = lambda x: ",".join([x] if isinstance(x, str) else x) if x else None
    try:
        row = (now or time.time(), cwd, query[:500], joined(types), joined(repos), int(rerank), float(hits[0]["cos"]) if hits else None, hits[0]["path"] if hits else None, len(hits))
        spark.createDataFrame([row], QUERIES).write.mode("append").parquet(path)
        return True
    except Exception:
        return False


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The query log; empty before the first logged query."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(QUERIES).parquet(path) if there else spark.createDataFrame([], QUERIES)


def recent(queries: DataFrame, now: float, days: int = DAYS) -> DataFrame:
    return queries.filter(F.col("ts") >= now - days * 86400)


def zero_hits(queries: DataFrame, now: float, limit: int = 50) -> DataFrame:
    """The latest queries with a low best score, or none."""
    return recent(queries, now).filter((F.col("top_score") < LOW_SCORE) | (F.col("n_results") == 0)).orderBy(F.desc("ts"), "query").limit(limit)


def frequent(queries: DataFrame, now: float, limit: int = 15) -> DataFrame:
    found = recent(queries, now).groupBy("query").agg(F.count("*").alias("n"), F.avg("top_score").alias("avg_score"))
    return found.orderBy(F.desc("n"), "query").limit(limit)


def stats(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def stale(chunks: DataFrame, files: DataFrame, skip_sessions: bool = True, limit: int = 50) -> DataFrame:
    """path, state of indexed files that are missing or whose content changed. files: path, content (binary, null if unreadable)."""
    known = chunks.filter(~F.col("path").startswith("git:"))
    known = known.filter(F.col("source_type") != "session") if skip_sessions else known
    known = known.select("path", "file_sha").distinct()
    there = files.select("path", F.sha1("content").alias("_sha"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("_sha").isNull(), "unreadable").when(F.col("_sha") != F.col("file_sha"), "modified")
    return known.join(there, "path", "left").select("path", state.alias("state")).filter("state is not null").orderBy("path").limit(limit)


def section(title: str, body: str) -> str:
    return f"## {title}\n\n{body}\n"


def report(queries: DataFrame, chunks: DataFrame, files: DataFrame, now: float) -> str:
    """Markdown of a few dozen rows."""
    bullets = lambda rows, f: "\n".join(f(r) for r in rows) or "_none_"
    when = time.strftime("%Y-%m-%d %H:%M", time.localtime(now))
    parts = [
        f"# Retrieval report ({when})\n",
        section("Index", f"{chunks.count()} chunks\n\n" + bullets(stats(chunks, "source_type").collect(), lambda r: f"- {r[0]}: {r[1]}") + "\n\n" + bullets(stats(chunks, "repo").collect(), lambda r: f"- {r[0]}: {r[1]}")),
        section("Frequent queries", bullets(frequent(queries, now).collect(), lambda r: f"- {r['n']} x {r['query']} (avg {r['avg_score'] or 0:.3f})")),
        section("Weak or empty", bullets(zero_hits(queries, now).collect(), lambda r: f"- {time.strftime('%m-%d %H:%M', time.localtime(r['ts']))} {r['query']}")),
        section("Stale files", bullets(stale(chunks, files).collect(), lambda r: f"- {r['state']}: {r['path']}")),
    ]
    return "\n".join(parts)
