"""Helpers that the corpus operators share: reading, scratch tables, text columns."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: A word of the contracts is a run of anything but these six ASCII spaces.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quarry.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.quarry.scratch", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Deletes the tables that are materialized inside, but for those that the body puts into the list it gets."""
    made, kept = [], []
    _open.append(made)
    try:
        yield kept
    finally:
        _open.remove(made)
        release(*[t for t in made if all(t is not k for k in kept)])


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_quarry_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the faster way where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_hashes(text: Column) -> list[Column]:
    """128 bits that stand for a text where rows are matched to what was found of them."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def keep_rows(docs: DataFrame, id_col: str, marks: list[Column], keys: DataFrame) -> DataFrame:
    """The rows of docs whose id and marks of the text are in keys (id, the marks, once), each key of which comes once.

    Ids may repeat, under one text or several, and may be null. Where once holds, one of the rows that agree in id and marks stays:
    the least one by all columns, which must be orderable.
    """
    names = [fresh(docs, f"_key{k}") for k in range(len(keys.columns))]
    keys = materialize(keys.toDF(*names), "keys")
    once, same = F.col(names[-1]), F.col(id_col).eqNullSafe(F.col(names[0]))
    for mark, name in zip(marks, names[1:], strict=False):
        same = same & (mark == F.col(name))
    if keys.filter(once).isEmpty():
        return docs.join(keys, same, "left_semi")
    found = docs.join(keys, same)
    least = found.filter(once).groupBy(*names[:-1]).agg(F.min(F.struct(*docs.columns)).alias(names[-1])).select(f"{names[-1]}.*")
    return found.filter(~once).select(*docs.columns).unionByName(least)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
