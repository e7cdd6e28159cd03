"""Versioned storage of the chunks table: immutable snapshots, a pointer to the current one, upserts, retention."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ..schema import CHUNKS


class Store:
    """Snapshots 1, 2, ... in a folder of any file system that Spark reads.

    Chunks lie in parts, one for each type and bucket of paths; a snapshot is a list of parts. A change writes anew the parts that it
    touches and takes over the others from the snapshot before, so an upsert of one file costs a bucket. A list is written after its
    parts, and its mark (_CURRENT/n) after the list, so a reader sees the old snapshot or the new one.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3, buckets: int = 16):
        self.spark, self.root, self.keep, self.buckets = spark, root.rstrip("/"), keep, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.schema = St._parse_datatype_string(CHUNKS)

    def _names(self, inner: str) -> list[str]:
        where = self.path(f"{self.root}/{inner}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def _numbers(self, inner: str, prefix: str = "") -> list[int]:
        return sorted(int(n[len(prefix) :]) for n in self._names(inner) if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def current(self) -> int | None:
        """The newest marked snapshot; it stands for the state of the store in caches."""
        return max(self._numbers("_CURRENT"), default=None)

    def parts(self, v: int | None) -> list[str]:
        """Folders of a snapshot: v=number/t=type/b=bucket."""
        if v is None or not self.fs.exists(self.path(f"{self.root}/_LISTS/{v}")):
            return []
        return [r[0] for r in self.spark.read.text(f"{self.root}/_LISTS/{v}").collect()]  # types x buckets

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.parts(self.current()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def write(self, chunks: DataFrame, taken_over: list[str] | None = None) -> int:
        """A new snapshot of chunks and of parts of the one before."""
        v = max([*self._numbers("", "v="), *self._numbers("_CURRENT")], default=0) + 1
        rows = chunks.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("t", F.hex(F.col("source_type").cast("binary"))).withColumn("b", self._bucket())
        rows.hint("rebalance", "t", "b").write.partitionBy("t", "b").parquet(f"{self.root}/v={v}")
        own = [f"v={v}/{t}/{b}" for t in self._names(f"v={v}") if t.startswith("t=") for b in self._names(f"v={v}/{t}") if b.startswith("b=")]
        listed = self.spark.createDataFrame([(p,) for p in [*(taken_over or []), *own]], "value string")
        listed.coalesce(1).write.text(f"{self.root}/_LISTS/{v}")
        self.fs.mkdirs(self.path(f"{self.root}/_CURRENT/{v}"))
        self.retain()
        return v

    def index_root(self) -> str | None:
        """Where indexes of the current snapshot are kept; they go with it."""
        v = self.current()
        return None if v is None else f"{self.root}/_INDEX/{v}"

    def retain(self) -> list[int]:
        """Deletes all but the newest keep snapshots, and the parts that only these had."""
        marks = self._numbers("_CURRENT")
        old = marks[: -self.keep] if self.keep else marks
        kept = {p for v in marks if v not in old for p in self.parts(v)}
        for v in old:
            for p in self.parts(v):
                if p not in kept:
                    self.fs.delete(self.path(f"{self.root}/{p}"), True)
            for place in (f"_CURRENT/{v}", f"_LISTS/{v}", f"_INDEX/{v}"):
                self.fs.delete(self.path(f"{self.root}/{place}"), True)
        return old

    def check(self) -> bool:
        """Reads the current snapshot; if that fails, its own parts are set aside and the snapshot before counts."""
        v = self.current()
        if v is None:
            return True
        try:
            self.read().agg(F.count("*"), F.count("text")).collect()
            return True
        except Exception:
            self.fs.delete(self.path(f"{self.root}/_CURRENT/{v}"), True)
            self.fs.rename(self.path(f"{self.root}/v={v}"), self.path(f"{self.root}/bad-{v}-{int(time.time())}"))
            return False

    def rebuild(self, chunks: DataFrame) -> int:
        """All chunks anew; session chunks go as well."""
        return self.write(with_ids(chunks))

    def upsert(self, paths: DataFrame, new: DataFrame) -> int:
        """Only parts of the buckets that the paths, or new chunks, fall into are read and written."""
        new = new.persist()
        try:
            touched = {f"b={r[0]}" for r in paths.select("path").unionByName(new.select("path")).select(self._bucket()).distinct().collect()}
            parts = self.parts(self.current())
            return self.write(upserted(self._read([p for p in parts if p.rpartition("/")[2] in touched]), paths, new), [p for p in parts if p.rpartition("/")[2] not in touched])
        finally:
            new.unpersist()

    def replace_type(self, source_type: str, new: DataFrame) -> int | None:
        """New rows for a whole type; without any, nothing changes."""
        if new.isEmpty():
            return None
        own = f"t={source_type.encode().hex().upper()}"
        return self.write(with_ids(new), [p for p in self.parts(self.current()) if p.split("/")[1] != own])


def with_ids(chunks: DataFrame, first: int = 0) -> DataFrame:
    """Ids by a hash of place and content: no count over all rows, and the same rows get the same ids again."""
    made = F.xxhash64("path", "start_line", "end_line", "symbol", "text", F.lit(first))
    out = chunks.withColumn("id", made)
    for name, kind in (("embedding", "array<float>"),):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def purged(base: DataFrame, paths: DataFrame) -> DataFrame:
    return base.join(paths.select("path").distinct(), "path", "left_anti")


def upserted(base: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of paths go, even if no new ones come; then new rows are added."""
    return purged(base, paths).select(*base.columns).unionByName(with_ids(new).select(*base.columns))


def sliced(base: DataFrame, source_type: str, new: DataFrame) -> DataFrame:
    return base.filter(F.col("source_type") != source_type).unionByName(with_ids(new).select(*base.columns))
