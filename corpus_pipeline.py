"""A corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents. Rows are told apart
by doc_id and text: a repeated doc_id with several texts is several documents. A null text counts as empty; the base rule rejects
null, empty and short texts, so later stages see none of them from the first, but they take them all the same: empty texts are exact
copies of each other, link with no near copy, aren't mixed in, and pack as one token. Very long texts go through whole. Where texts
or scores tie, doc_id decides, then the least row by all columns. An empty table stays empty. Extra columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import dedup, mixing, neardup, packing, rules
from quarry.llm.common import documents, materialize, release, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects; repeated rows all stay or all go."""
    return rules.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: the document of the largest doc_id, a null one last."""
    return dedup.drop_copies(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of Jaccard similarity 0.75 connect, one row: the document of the smallest doc_id. Wordless texts all stay."""
    return neardup.drop_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, up to three times; wordless ones go."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of at most 1024 tokens; each row is a document of its own."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]
#: Learned rules and subset sums aren't SQL; tests/llm/test_pipeline.py follows the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes once its result is there, and that once the next one's is."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            out = materialize(stage(spark, docs, sf_dir), name)
            kept.append(out)
        release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
