"""Mixing sources to target weights by a low-discrepancy schedule.

The golden-ratio sequence frac(i * phi) fills [0, 1) evenly at every length. Slot i of the mix goes to the source whose part
of the cumulative shares of slots holds point i; the slots of a source are ranked, and its k-th slot takes its k-th block of
equal token count, from the documents of the source in shuffled order, round and round again (three rounds at most). A source's
blocks have a size of their own, so that none is mostly empty, and its share of slots is its target over that size. Slots beyond
the target go, slots that the points leave out are added, and the last one takes only the words that the target still lacks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, text_hashes, word_count

GOLDEN = 0.6180339887498949
SLOTS, MOST_BLOCK, ROUNDS, CELLS, SHARD_SLOTS = 65536, 4096, 3, 4096, 4096
#: Sources take these weights in turn.
WEIGHTS = (1.0, 2.0, 3.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with weight, target. Window functions over one row a source.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... Target: min(ROUNDS * size, x * weight) with the x that makes
    the targets sum up to all sizes; it is found by sorting the sources by ROUNDS * size / weight, the order in which they
    reach their limit as x grows.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    known = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (nth % len(WEIGHTS) + 1).cast("int")))
    known = known.withColumn("most", F.col("source_size").cast("double") * ROUNDS).withColumn("turn", F.col("most") / F.col("weight"))
    everything, upto = Window.partitionBy(F.lit(1)), Window.orderBy("turn", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # the first source, in that order, that the level of those from it on doesn't fill
    known = known.withColumn("x", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "level"))).over(everything)["level"])
    return known.withColumn("target", F.least("most", F.coalesce("x", F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "weight", "target")


def _running(df: DataFrame, by: list[str], shard: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of value over the rows before, by group and order. Each shard is summed by itself; shards rise with the order."""
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in by]
    df = df.withColumn("_g", F.concat_ws("\x01", *group))
    totals = df.groupBy("_g", shard).agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_g").orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_g", shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inner", inner).join(before, ["_g", shard]).withColumn(out, F.col("_before") + F.col("_inner")).drop("_g", "_before", "_inner")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    A null text has size 0; a null source is a source of its own. Rows that repeat a doc_id are separate documents. Documents
    of size 0 are taken 0 times. A text longer than a block lies in several and is taken in part where not all of them are. An
    empty table, or one without words, takes nothing. The order is a function of doc_id, size and text, so reruns agree. Other
    columns are ignored.
    """
    return _mixed(docs, id_col, text_col, source_col).drop("h1", "h2")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of mix with the hashes of their texts."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *text_hashes(F.col(text_col)))
    sized = materialize(sized, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialize(source_targets(sizes.select("source", "source_size")).join(sizes.select(F.col("source").alias("_s"), "rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    total, rows = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    block = max(1, min(MOST_BLOCK, total // SLOTS))
    # words of a block of the source; whole rounds, whole slots and the words of one more that make up the target
    plan = targets.filter("source_size > 0 and target > 0").withColumn("wide", F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / block)))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("wide"))).withColumn("full", F.floor(F.col("target") / F.col("source_size")))
    plan = plan.withColumn("left", F.round(F.col("target")).cast("long") - F.col("full") * F.col("source_size")).withColumn("whole", F.col("full") * F.col("blocks") + F.floor(F.col("left") / F.col("wide"))).withColumn("rest", F.pmod("left", "wide"))
    plan = plan.withColumn("share", F.col("target") / F.col("wide")).select("source", "source_size", "wide", "blocks", "whole", "rest", "share")
    plan = materialize(plan, "plan")
    slots = math.ceil(plan.agg(F.coalesce(F.sum("share"), F.lit(0.0))).first()[0])

    # documents in shuffled order on their source's line of tokens, which is cut into blocks
    shards = max(1, round(rows**0.5))  # as many as rows in each, so neither a shard nor the table of shards grows fast
    key = F.xxhash64("doc_id", "size")
    lined = sized.withColumn("key", key).withColumn("shard", F.floor((F.shiftrightunsigned("key", 1) / F.lit(float(2**63))) * shards).cast("int")).withColumn("key", F.shiftrightunsigned("key", 1))
    lined = _running(lined, ["source"], "shard", ["key", "doc_id", "size", "h1", "h2"], "size", "start")
    joined = lambda a, b: a.join(b.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    lined = joined(lined, targets.select("source", "source_size", "target")).withColumn("row", F.struct("doc_id", "size", "start"))

    # points to sources: each source's part of [0, 1) lies in a few of CELLS cells, so the lookup is a join on the cell
    upto = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, 0)
    parts = plan.withColumn("high", F.sum("share").over(upto)).withColumn("low", F.col("high") - F.col("share"))
    scale = F.greatest(F.sum("share").over(Window.partitionBy(F.lit(1))), F.lit(1e-9))
    parts = parts.withColumn("low", F.col("low") / scale).withColumn("high", F.when(F.col("high") >= scale * (1 - 1e-12), F.lit(1.0)).otherwise(F.col("high") / scale))
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)).cast("int")
    parts = parts.select("source", "blocks", "whole", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    points = docs.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN).alias("p")).withColumn("p", F.col("p") - F.floor("p")).withColumn("cell", cell("p"))
    placed = points.join(parts, "cell").filter((F.col("p") >= F.col("low")) & (F.col("p") < F.col("high"))).select("slot", "source", "blocks", "whole", F.lit(1).cast("long").alias("one"), F.floor(F.col("slot") / SHARD_SLOTS).alias("span"))
    ranked = _running(placed, ["source"], "span", ["slot"], "one", "rank")
    given = ranked.filter(F.col("rank") < F.col("whole")).select("source", (F.col("rank") % F.col("blocks")).alias("block"), F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("rest"))
    met = placed.groupBy("source").agg(F.count("*").alias("met")).withColumnRenamed("source", "_s")
    lacking = plan.join(met, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("met", F.coalesce("met", F.lit(0))).filter("met < whole")
    lacking = lacking.select("source", "blocks", F.explode(F.sequence("met", F.col("whole") - 1)).alias("rank")).select("source", (F.col("rank") % F.col("blocks")).alias("block"), F.lit(1).cast("long"), F.lit(0).cast("long"))
    last = plan.filter("rest > 0").select("source", (F.col("whole") % F.col("blocks")).alias("block"), F.lit(0).cast("long"), "rest")
    rounds = given.union(lacking).union(last).groupBy("source", "block").agg(F.sum("times").alias("times"), F.sum("rest").alias("rest"))

    # a document's words lie in one block or in a few
    lined_wide = joined(lined.filter("size > 0"), plan.select("source", "wide"))
    wide = F.col("wide")
    first, final = F.floor(F.col("start") / wide), F.floor((F.col("start") + F.col("size") - 1) / wide)
    pieces = lined_wide.select("source", "row", "wide", F.explode(F.sequence(first, final)).alias("block"))
    from_word = F.greatest(F.col("row.start"), F.col("block") * wide)
    upto_word = lambda end: F.greatest(F.least(F.col("row.start") + F.col("row.size"), F.col("block") * wide + end) - from_word, F.lit(0))
    rounds = rounds.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "times", "rest")
    taken = pieces.join(rounds, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).groupBy("source", "row").agg(F.sum(upto_word(wide) * F.col("times") + upto_word(F.col("rest"))).alias("taken"))
    taken = taken.select(F.col("source").alias("_s"), F.col("row").alias("_r"), "taken")
    out = lined.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("row") == F.col("_r")), "left")
    return out.select("doc_id", "source", "h1", "h2", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size, rounded. Documents without words go.

    Rows that agree in doc_id, source and text are taken together: the least of them by all columns, which must be orderable, comes as
    often as they are all taken. Rows with one doc_id and different texts or sources are documents of their own.
    """
    names = [fresh(docs, f"_key{k}") for k in range(4)]
    times, rows, least = fresh(docs, "_times"), fresh(docs, "_rows"), fresh(docs, "_least")
    found = _mixed(docs, id_col, text_col, source_col).filter("size > 0").groupBy("doc_id", "source", "h1", "h2").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias(times), F.count("*").alias(rows))
    found = materialize(found.filter(F.col(times) > 0).toDF(*names, times, rows), "times")
    h1, h2 = text_hashes(F.col(text_col))
    same = F.col(id_col).eqNullSafe(F.col(names[0])) & F.col(source_col).cast("string").eqNullSafe(F.col(names[1])) & (h1 == F.col(names[2])) & (h2 == F.col(names[3]))
    out = docs.join(found, same)
    if not found.filter(F.col(rows) > 1).isEmpty():
        many = out.filter(F.col(rows) > 1).groupBy(*names).agg(F.min(F.struct(*docs.columns)).alias(least), F.first(times).alias(times)).select(f"{least}.*", times)
        out = out.filter(F.col(rows) == 1).select(*docs.columns, times).unionByName(many)
    copy = fresh(out, "_copy")
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
