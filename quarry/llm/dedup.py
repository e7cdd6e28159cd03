"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get integers as names, so two
blocks have one name only if they are equal. Then adjacent names are paired, the distinct pairs sorted and named, and so on
until each text has a single name: texts are equal exactly if level and name agree. Nothing rests on a hash being free of
collisions: blocks are joined to their names by a digest only after a check that no two distinct blocks share one, else by
the blocks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_rows, materialize, release

BLOCK_BYTES, LEAD_BYTES = 8192, 16
#: Stands for a null doc_id, below all others.
NO_ID = -(2**63)


def _sorted_names(keys: DataFrame, by: list[str], tag: str, keep: list[str]) -> DataFrame:
    """Integer names in the order of the sorted distinct keys. Written at once: the names must not be made twice."""
    named = keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id())
    return materialize(named.select(*keep, "name"), tag)


def block_identities(docs: DataFrame, key: list[str], content: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key columns, level, name, copies: equal (level, name) means equal content.

    docs has key columns and a binary column content without nulls. Rows with equal key must have equal content; copies says
    how many such rows there were (rows of one block are not merged and have copies 1).
    """
    size = F.lit(block_bytes)
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(content) / size).cast("int") - 1, F.lit(0))),
        lambda i: F.substring(F.col(content), i * size + 1, size),
    )
    blocks = (
        docs.select(*key, F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)).cast("int").alias("parts"), F.posexplode(cut).alias("at", "block"))
        .withColumn("digest", F.unhex(F.sha2("block", 256)))
    )
    # one row a distinct block; sorted by its first bytes and digest, so that whole blocks are neither sampled nor moved again
    keys = blocks.select("block").distinct().select(F.substring("block", 1, LEAD_BYTES).alias("lead"), F.unhex(F.sha2("block", 256)).alias("digest"))
    names = _sorted_names(keys, ["lead", "digest"], "names", ["digest"])
    if names.groupBy("digest").count().filter("count > 1").isEmpty():
        now = blocks.drop("block").join(names, "digest").drop("digest")
    else:
        release(names)
        names = _sorted_names(blocks.select("block").distinct(), ["block"], "names", ["block"])
        now = blocks.drop("digest").join(names, "block").drop("block")
    now = materialize(now.withColumn("copies", F.lit(1).cast("long")), "level")
    release(names)
    done, level = [now.filter("parts = 1").select(*key, F.lit(0).alias("level"), "name", "copies")], 0
    longest = now.agg(F.max("parts")).first()[0] or 1
    rest, first = now.filter("parts > 1"), True
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = rest.groupBy(*key, F.floor(F.col("at") / 2).cast("int").alias("at"), F.ceil(F.col("parts") / 2).cast("int").alias("parts")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            (F.count(F.when(F.col("at") % 2 == 0, 1)) if first else F.max("copies")).cast("long").alias("copies"),
        )
        pairs, first = materialize(pairs, "pairs"), False
        names = _sorted_names(pairs.select("left", "right").distinct(), ["left", "right"], "names", ["left", "right"])
        now = pairs.join(names, ["left", "right"]).drop("left", "right")
        done.append(now.filter("parts = 1").select(*key, F.lit(level).alias("level"), "name", "copies"))
        rest = now.filter("parts > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit(""))).cast("binary")


def _sha(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _groups(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """doc_id (NO_ID for null), sha, copies, keep_id, group_size: a row for each doc_id and normalised text."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), _normal(F.col(text_col)).alias("norm")).select("doc_id", _sha(F.col("norm")).alias("sha"), "norm")
    named = block_identities(keyed, ["doc_id", "sha"], "norm", block_bytes)
    rows = named.groupBy("level", "name", "doc_id", "sha").agg(F.sum("copies").alias("copies"))
    # written before it is joined to the rows, so that a large group's join can be split
    groups = materialize(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after A-Z became a-z. The largest doc_id of equal texts stays. A null text counts as empty,
    and empty texts are equal to each other. Of rows that repeat a doc_id and text, one is kept; rows that repeat a doc_id with
    different texts are documents of their own. A null doc_id is below all others. A text of any length is cut into blocks, so no
    row is larger than a block once it is cut. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    each = _groups(docs, id_col, text_col, block_bytes).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return each.select(
        real("doc_id"), real("keep_id"), "group_size", ((F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns: one of each group of equal texts.

    Rows are told apart by doc_id and text, so a row stays or goes by its own text whatever else has its doc_id. Of rows that agree
    in both, the least by all columns stays. Odd rows are treated as in exact_dedup.
    """
    kept = _groups(docs, id_col, text_col, block_bytes).filter("doc_id = keep_id")
    keys = kept.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")), "sha", F.col("copies") > 1)
    return keep_rows(docs, id_col, [_sha(_normal(F.col(text_col)))], keys)
