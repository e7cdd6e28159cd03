"""Incremental maintenance of the store by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..functions import paths
from ..operators import chunking, models
from ..plans.store import Store

FILES = "path string, modificationTime timestamp, length long, content binary"
DRIFT_LEAST, DRIFT_MOST, DRIFT_HOURS = 3, 25, 6


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that appear in a folder. A file source sees a path once; refresh() finds those that change later."""
    return spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def as_files(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows of the binary file source as chunk_files takes them; types come from the paths again."""
    path = F.regexp_replace("path", "^file:/*", "/")
    out = rows.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha1("content").alias("file_sha"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return out.withColumn("source_type", paths.source_type(F.col("path"), settings.code_globs)).withColumn("repo", paths.repo_of(F.col("path"), settings.repos))


def reindex(store: Store, files: DataFrame, settings: Settings, embed_factory=None) -> int:
    """Purges the files' chunks and adds new ones; quarantined files are purged only. Of a file that comes twice the newer one counts."""
    latest = files.groupBy("path").agg(F.max_by(F.struct(*files.columns), "mtime").alias("f")).select("f.*")
    new = chunking.chunk_files(latest.filter(~paths.is_quarantined(F.col("path"))), settings)
    new = models.embed(new, F.col("embed_text"), embed_factory, settings.dim).drop("embed_text", "chunk_no")
    return store.upsert(latest.select("path"), new)


def follow(spark: SparkSession, store: Store, folder: str, checkpoint: str, settings: Settings, embed_factory=None, available_now: bool = True) -> StreamingQuery:
    """Keeps the store up to date with a folder. Batches are upserts by path, so one that is repeated after a failure changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            reindex(store, as_files(rows, settings), settings, embed_factory)

    out = changed_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def refresh(store: Store, folder: str, settings: Settings, embed_factory=None) -> int | None:
    """Reindexes the files of a folder that are new or younger than their chunks, and purges those that are gone.

    Times come from the listing; the contents of unchanged files aren't read. None if nothing changed.
    """
    spark = store.spark
    listed = spark.read.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    times = listed.select(path.alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("now"))
    known = store.read().groupBy("path").agg(F.max("mtime").alias("then"))
    inside = known.filter(F.col("path").startswith(folder.removeprefix("file://").rstrip("/") + "/"))
    both = times.join(inside, "path", "full")
    gone = both.filter("now is null").select("path")
    changed = both.filter("now is not null and (then is null or now > then)").select("path").persist()
    try:
        if changed.isEmpty() and gone.isEmpty():
            return None
        new = as_files(listed.join(changed.withColumnRenamed("path", "_p"), path == F.col("_p"), "left_semi"), settings)
        made = chunking.chunk_files(new.filter(~paths.is_quarantined(F.col("path"))), settings)
        made = models.embed(made, F.col("embed_text"), embed_factory, settings.dim).drop("embed_text", "chunk_no")
        return store.upsert(changed.unionByName(gone), made)
    finally:
        changed.unpersist()


def drifted(store: Store, files: DataFrame, hours_since: float) -> DataFrame | None:
    """Of files those newer than or missing in the store, DRIFT_MOST at most; None if they are few or the last look was lately."""
    if hours_since < DRIFT_HOURS:
        return None
    known = store.read().groupBy("path").agg(F.max("file_sha").alias("_sha"))
    found = files.join(known, "path", "left").filter(F.col("_sha").isNull() | (F.col("_sha") != F.col("file_sha"))).drop("_sha").orderBy("path").limit(DRIFT_MOST)
    return found if found.count() >= DRIFT_LEAST else None
