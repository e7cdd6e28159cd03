"""BM25 over chunks: postings, statistics of a scope, scores.

N, document frequencies and the mean length are those of the scoped chunks. An index is made in one pass over the texts, which
workers read a slice at a time: a text's terms and their counts stay in its row, so nothing but document frequencies is shuffled, and
N, lengths and terms come from these rows. They are kept in the executors' memory and disks, or written as tables bucketed by term, of
which a question reads only the buckets of its terms.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..ship import ship, small_batches

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings of a stored bucket, about.
BUCKET_ROWS = 2_000_000
#: Characters of texts that a worker holds as Python objects, about; raw tokens whose terms it remembers.
SLICE_CHARS, REMEMBERED = 1 << 19, 1 << 17
#: The patterns of functions.text as Python writes them: a word character is a letter, a number or an underscore.
RAW, SUB, PLAIN = re.compile(r"[A-Za-z_][\w$]+"), re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[a-z]+|[A-Z]+|\d+"), re.compile(r"[A-Z]?[a-z]+\Z")


@dataclass
class Index:
    """postings: id, term, tf, length; terms: term, df, cf, idf; n, mean_length of the scope. A stored one has buckets (0: kept)."""

    postings: DataFrame
    terms: DataFrame
    n: int
    mean_length: float
    buckets: int = 0
    kept: DataFrame | None = None

    def release(self) -> None:
        (self.postings if self.kept is None else self.kept).unpersist()
        self.terms.unpersist()

    def save(self, path: str) -> Index:
        """Writes the tables, statistics last: without them load doesn't see the index."""
        spark = self.postings.sparkSession
        buckets = max(1, self.postings.count() // BUCKET_ROWS)
        for name, rows in (("postings", self.postings), ("terms", self.terms)):
            dealt = rows.withColumn("bucket", bucket(F.col("term"), buckets)).hint("rebalance", "bucket")
            dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        spark.createDataFrame([(self.n, self.mean_length, buckets)], "n long, mean_length double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        self.release()
        return load(spark, path)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def load(spark: SparkSession, path: str) -> Index | None:
    """A stored index, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    n, mean, buckets = spark.read.parquet(f"{path}/stats").first()
    read = lambda name, columns: spark.read.schema(f"{columns}, bucket int").parquet(f"{path}/{name}")
    return Index(read("postings", "id long, term string, tf long, length long"), read("terms", "term string, df long, cf long, idf double"), n, mean, buckets)


def doc_lengths(chunks: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    return chunks.select(F.col(id_col).alias("id"), F.size(tokens(F.col("text") if text is None else text)).alias("length"))


def terms_of(raw: str) -> tuple[str, ...]:
    """Terms of one raw token, as functions.text.tokens gives them."""
    if PLAIN.match(raw):
        return (raw.lower(),)
    parts = [p for p in SUB.findall(raw) if len(p) >= 2]
    return (raw.lower(), *map(str.lower, parts)) if len(parts) > 1 else (raw.lower(),)


def _count(kind: pa.DataType):
    def run(frames):
        known: dict[str, tuple[str, ...]] = {}
        for frame in frames:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(frame.column(1)), 0).to_numpy(zero_copy_only=False) + 1)
            low = 0
            while low < frame.num_rows:
                stop = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + SLICE_CHARS, side="right")))
                yield counted(frame.slice(low, stop - low), known)
                low = stop

    def counted(part: pa.RecordBatch, known: dict) -> pa.RecordBatch:
        words, times, lengths, ends = [], [], [], [0]
        for text in part.column(1).to_pylist():
            found: Counter[str] = Counter()
            for raw, n in Counter(RAW.findall(text or "")).items():
                of = known.get(raw)
                if of is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    of = known[raw] = terms_of(raw)
                for term in of:
                    found[term] += n
            words += found
            times += found.values()
            lengths.append(found.total())
            ends.append(len(words))
        cut = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(words, pa.string())), pa.ListArray.from_arrays(cut, pa.array(times, pa.int64()))]
        return pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.array(lengths, pa.int64()), *lists], ["id", "length", "terms", "tfs"])

    return run


def counted(chunks: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    """id, length, terms, tfs: a row a text, of its distinct terms and how often each occurs."""
    ship(chunks.sparkSession)
    small_batches(chunks.sparkSession)
    rows = chunks.select(F.col(id_col).alias("id"), (F.col("text") if text is None else text).alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_count(to_arrow_type(kind)), f"id {kind.simpleString()}, length long, terms array<string>, tfs array<long>")


def flat(rows: DataFrame) -> DataFrame:
    """id, term, tf, length of counted rows."""
    return rows.select("id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("_p")).select("id", F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("tf"), "length")


def postings(chunks: DataFrame, id_col: str = "id", text: Column | None = None) -> DataFrame:
    """id, term, tf, length; ids are unique."""
    return flat(counted(chunks, id_col, text))


def term_counts(found: DataFrame) -> DataFrame:
    """term, df, cf (all occurrences)."""
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def document_frequencies(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """term, df alone: a text's distinct terms are found in its row, so one row a pair is summed and nothing else is shuffled."""
    return chunks.select(F.explode(F.array_distinct(tokens(F.col("text") if text is None else text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)


def build(chunks: DataFrame, id_col: str = "id", text: Column | None = None) -> Index:
    """One pass for postings and one aggregation for terms; a negative idf becomes EPSILON times the mean of all."""
    kept = counted(chunks, id_col, text).persist()
    found = flat(kept)
    n = kept.count()
    raw = term_counts(found).withColumn("raw", idf(F.col("df"), n)).persist()
    total, mean_idf = raw.agg(F.sum("cf"), F.avg("raw")).first()
    floor = EPSILON * (mean_idf or 0.0)
    terms = raw.select("term", "df", "cf", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf")).persist()
    terms.count()
    raw.unpersist()
    return Index(found, terms, n, (total or 0) / max(n, 1) or 1.0, kept=kept)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """query_id, term, times: a term that a query repeats counts as often."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _part(index: Index) -> Column:
    tf, norm = F.col("tf"), 1 - B + B * F.col("length") / max(index.mean_length, 1e-12)
    return F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, id, bm25 of chunks with a term of the query; all others have 0."""
    wanted = query_terms(queries).join(index.terms.select("term", "idf"), "term")
    return index.postings.join(wanted, "term").groupBy("query_id", "id").agg(F.sum(_part(index)).alias("bm25"))


def score_one(index: Index, query: str) -> DataFrame:
    """id, bm25 of chunks with a term of one query. Its terms are looked up first, so only their postings are read."""
    spark = index.postings.sparkSession
    asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times")).withColumn("bucket", bucket(F.col("term"), max(1, index.buckets))).collect()
    words = [r["term"] for r in asked]

    def some(rows: DataFrame) -> DataFrame:
        rows = rows.filter(F.col("term").isin(words))
        return rows.filter(F.col("bucket").isin(sorted({r["bucket"] for r in asked}))) if index.buckets else rows

    idfs = {r["term"]: r["idf"] for r in some(index.terms).select("term", "idf").collect()} if words else {}
    known = spark.createDataFrame([(r["term"], float(r["times"]), idfs[r["term"]]) for r in asked if r["term"] in idfs], "term string, times double, idf double")
    if index.kept is None:
        rows = some(index.postings)
    else:  # of each text the question's terms alone become rows
        has = F.arrays_overlap("terms", F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
        rows = index.kept.filter(has).withColumn("_p", F.explode(F.filter(F.arrays_zip("terms", "tfs"), lambda p: p["terms"].isin(words))))
        rows = rows.select("id", F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("tf"), "length")
    return rows.join(F.broadcast(known), "term").groupBy("id").agg(F.sum(_part(index)).alias("bm25"))  # a row a word of the question
