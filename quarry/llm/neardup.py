"""Exact Jaccard self-join of word-shingle sets and its connected components.

Sets are equal to their fingerprint's class; classes (nodes) are joined, not documents. All tokens have one global order:
those in the counted part of the hash space (CUT of it) by how many nodes hold them, rarest first, then the others by hash, then
hot ones. If 4 |A & B| >= 3 |A | B|, the first n / 4 + 1 tokens of A and of B (n: the set's size) have a token in common. So nodes
meet under the tokens of these prefixes; a token of one node only leaves no trace but its place in the order. Counting, placing
and meeting are window functions over plain rows (token, node), so a task holds no more than Spark's sort does. The nodes that
meet under a token are put under one name, the hub, and all sets under a hub are compared in a prefix tree. A hub with very
many tokens of sets is parted by size (similar sets differ by 4/3 at most). Groups are cut into blocks that share their least node; links
between blocks come from a second pass over those nodes that the first has not linked to that node's component, so no link between
components is lost.

Hashes are 64 bits: two different shingles of one pair of texts fall together with a chance of about n * n / 2**64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import keep_rows, materialize, release, text_hashes
from .graph import components
from .shingles import fingerprint, in_slices, mix, shingle_sets
from .trie import similar_groups

CUT = 0.4
#: A token is hot in that share of the nodes, or that part of all tokens: so at most MOST_HOT are broadcast, 16 bytes each.
HOT_SHARE, HOT_LEAST, MOST_HOT = 0.002, 64, 1 << 19
BATCH_TOKENS, MOST_BITS = 1_000_000, 27
#: Tokens of a block's sets in the first pass, and in the second; groups of more than the second number are parted by size.
FIRST_TOKENS, BLOCK_TOKENS = 1 << 15, 1 << 17
EDGE = np.uint64(int(CUT * 2**64))


def prefix_length(n):
    return n - (3 * n + 3) // 4 + 1


def _values(column):
    """One by one, so that a frame's texts aren't all held as Python strings."""
    return (x.as_py() for x in column)


def _batches(frames, most: int):
    """Lists of ((doc_id, h1, h2), set) with about most tokens together."""
    batch, size = [], 0
    for frame in frames:
        keys = list(zip(*(frame.column(c).to_pylist() for c in ("doc_id", "h1", "h2")), strict=True))
        for first, part in in_slices(_values(frame.column("text"))):
            for k, own in enumerate(shingle_sets(part)):
                batch.append((keys[first + k], own))
                size += len(own)
            if size >= most:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


NODES = "doc_id long, h1 long, h2 long, n_shingles long, node long, token long"


def _nodes(frames):
    """Of each document: its key, n_shingles and node. Beside these, tokens that are frequent in a batch, with their count and least node."""
    for batch in _batches(frames, BATCH_TOKENS):
        nodes = [fingerprint(s) if len(s) else None for _, s in batch]
        distinct = {}
        for node, (_, own) in zip(nodes, batch, strict=True):
            if node is not None:
                distinct.setdefault(node, own)
        names = ["doc_id", "h1", "h2", "n_shingles", "node", "token"]
        rows = [[k[j] for k, _ in batch] for j in range(3)] + [[len(s) for _, s in batch], nodes, [None] * len(batch)]
        if distinct:
            keys, own = np.array(list(distinct), dtype=np.int64), list(distinct.values())
            tokens = np.concatenate(own)
            holder = np.repeat(keys, [len(s) for s in own])
            order = np.argsort(tokens, kind="stable")
            tokens, holder = tokens[order], holder[order]
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            count = np.diff(np.append(first, len(tokens)))
            hot = count >= max(4, HOT_SHARE / 2 * len(keys))
            for row, more in zip(rows, ([None] * int(hot.sum()),) * 3 + (count[hot].tolist(), np.minimum.reduceat(holder, first)[hot].tolist(), tokens[first][hot].view(np.int64).tolist()), strict=True):
                row += more
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names)


TOKENS = "token long, node long, info long, kind int"
#: Kinds of such rows: a token of a node; what is known of a node; a hub that a node lies under.
TOKEN, NODE, HUB = 0, 1, 2


def _tokens(hot, chosen):
    """Emits, of each distinct set of the task, the tokens that can lie in its prefix, under a number that stands for the set.

    The numbers rise by 1, so that rows are small when compressed, however many partitions they are dealt to. Beside the tokens there is
    a row of kind NODE, with the set's fingerprint for token and n << 32 | how many of its tokens are counted for info, and, if
    hot tokens get into the prefix, rows of kind HUB, with the hub for info and a token that only deals them out. hot: broadcast
    (tokens, hubs), rarest first.
    """

    def run(frames):
        hot_tokens, hubs = hot.value
        by_value = np.argsort(hot_tokens)
        sorted_hot, seen, number = hot_tokens[by_value], set(), TaskContext.get().partitionId() << 32
        for frame in _chosen(frames, *chosen.value):
            for _, part in in_slices(_values(frame.column("text"))):
                fresh = {}
                for s in shingle_sets(part):
                    if len(s) and (node := fingerprint(s)) not in seen:
                        seen.add(node)
                        fresh[node] = s
                if fresh:
                    yield rows_of(np.array(list(fresh), dtype=np.int64), number + np.arange(len(fresh)), list(fresh.values()), sorted_hot, by_value, hubs)
                    number += len(fresh)

    def rows_of(nodes, numbers, sets, sorted_hot, by_value, hubs):
        n = np.array([len(s) for s in sets], dtype=np.int64)
        most = prefix_length(n)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
        under = np.empty((2, 0), dtype=np.int64)
        if len(sorted_hot):
            at = np.minimum(np.searchsorted(sorted_hot, tokens), len(sorted_hot) - 1)
            is_hot = sorted_hot[at] == tokens
            place, holder = by_value[at[is_hot]], owner[is_hot]
            tokens, owner = tokens[~is_hot], owner[~is_hot]
            room = most - np.bincount(owner, minlength=len(n))  # hot tokens of the prefix: the rarest ones
            order = np.lexsort((place, holder))
            place, holder = place[order], holder[order]
            rank = np.arange(len(holder)) - np.searchsorted(holder, np.arange(len(n)))[holder]
            take = rank < room[holder]
            under = np.unique(np.stack([numbers[holder[take]], hubs[place[take]]]), axis=1)
        counted = tokens < EDGE
        inside = np.bincount(owner[counted], minlength=len(n))
        rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(n)))[owner]
        keep = counted | (rank < most[owner])
        tokens, owner = tokens[keep].view(np.int64), owner[keep]
        spread = mix(under[0].view(np.uint64)).view(np.int64)
        known = pa.concat_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(n << 32 | inside), pa.array(under[1])])
        kind = np.repeat(np.array([TOKEN, NODE, HUB], dtype=np.int32), [len(tokens), len(n), len(spread)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([tokens, nodes, spread])), pa.array(np.concatenate([numbers[owner], numbers, under[0]])), known, pa.array(kind)], ["token", "node", "info", "kind"])

    return run


def meet(tokens: DataFrame) -> DataFrame:
    """hub, node (fingerprint), n of the nodes that have a token in their prefix which other nodes have as well; hubs are mere names."""
    whole = Window.partitionBy("token")
    met = tokens.select("*", F.min("node").over(whole).alias("hub"), F.max("node").over(whole).alias("last"), F.count("*").over(whole).alias("count"))
    met = met.filter((F.col("kind") != TOKEN) | (F.col("last") > F.col("hub"))).drop("last")
    outer = (F.col("token") < 0) | (F.col("token") >= int(EDGE))
    turn = F.when(F.col("kind") == NODE, 0).when((F.col("kind") == TOKEN) & ~outer, 1).otherwise(2)
    # the row of the node itself comes first, then its tokens, most frequent first: those of one node only aren't here, so a token's
    # place in the order is seen from the end of the counted ones
    listed = Window.partitionBy("node").orderBy(turn, F.desc("count"), F.desc("token"))
    so_far = listed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = met.select("*", (F.row_number().over(listed) - 1).alias("from_end"), F.first("token").over(so_far).alias("print"), F.first("info").over(so_far).alias("known"), turn.alias("turn"))
    placed = placed.withColumn("n", F.shiftright("known", 32)).withColumn("inside", F.col("known").bitwiseAND((1 << 32) - 1))
    found = placed.filter((F.col("turn") == 2) | (F.col("turn") == 1) & (F.col("inside") - F.col("from_end") < F.col("n") - F.expr("(3 * n + 3) div 4") + 1))
    hub = F.when(F.col("kind") == HUB, F.col("info")).otherwise(F.col("hub"))
    own = found.select("node", hub.alias("hub"), "print", "n").distinct()  # the rows of a node are in one partition
    return own.select("hub", F.col("print").alias("node"), "n").distinct()


def _in_blocks(frames):
    """Frames sorted by hub, x, y: (x, y) names a block of a hub. Emits a, b: each node and the least one of its group."""
    ids, texts, asks, now = [], [], [], None

    def links():
        sets = []
        for _, part in in_slices(texts):
            sets += shingle_sets(part)
        groups = similar_groups(sets, asks=None if all(asks) else asks)
        pairs = [(ids[groups.find(i)], ids[i]) for i in range(len(ids))]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_pydict({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    for frame in frames:
        cols = [frame.column(c).to_pylist() for c in ("hub", "x", "y", "node", "text", "asks")]
        for hub, x, y, node, text, ask in zip(*cols, strict=True):
            if (hub, x, y) != now:
                if len(ids) > 1:
                    yield links()
                ids, texts, asks, now = [], [], [], (hub, x, y)
            ids.append(node)
            texts.append(text)
            asks.append(ask)
    if len(ids) > 1:
        yield links()


def _place(ids: pa.Array, mask: int) -> np.ndarray:
    return mix(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(mask)


def _chosen(frames, bits: np.ndarray, mask: int):
    """Rows whose doc_id may be among those that set their bits; a filter of fixed size that only saves work."""
    for frame in frames:
        x = _place(frame.column("doc_id"), mask)
        yield frame.filter(pa.array((bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63)).astype(np.int64)) & 1 == 1))


def _filter_of(ids: DataFrame):
    """Broadcast (bits, mask) of the doc_ids of a one-column frame, at most 2**MOST_BITS bits."""
    size = 1 << min(MOST_BITS, max(12, (16 * ids.count()).bit_length()))

    def places(frames):
        for frame in frames:
            yield pa.RecordBatch.from_pydict({"x": pa.array(_place(frame.column("doc_id"), size - 1).view(np.int64))})

    words = ids.mapInArrow(places, "x long").groupBy(F.shiftright("x", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("word")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return ids.sparkSession.sparkContext.broadcast((bits, size - 1))


def _texts(chosen):
    """node, text of the chosen rows: the node is that of the row's own text."""

    def run(frames):
        for frame in _chosen(frames, *chosen.value):
            texts = frame.column("text").to_pylist()
            for first, part in in_slices(texts):
                sets = shingle_sets(part)
                yield pa.RecordBatch.from_pydict({"node": pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()), "text": pa.array(texts[first : first + len(part)], pa.string())})

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row doc_id, h1, h2 (of its text), n_shingles, node and comp: the least node of its component, null without shingles."""
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = materialize(text.select("*", *text_hashes(F.col("text"))).mapInArrow(_nodes, NODES), "nodes")
    known = both.filter("token is null").drop("token")
    count, tokens = known.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    if not tokens:
        return known.withColumn("comp", F.lit(None).cast("long"))
    least = max(HOT_LEAST, HOT_SHARE * count, tokens / MOST_HOT)
    hot = both.filter("token is not null").groupBy("token").agg(F.sum("n_shingles").alias("count"), F.min("node").alias("hub")).filter(F.col("count") >= least).toArrow().sort_by([("count", "ascending"), ("token", "ascending")])
    sent = spark.sparkContext.broadcast((hot.column("token").to_numpy().view(np.uint64), hot.column("hub").to_numpy()))
    first = materialize(known.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "first")  # min passes over nulls

    meetings = materialize(meet(text.mapInArrow(_tokens(sent, _filter_of(first.select("doc_id"))), TOKENS)), "meetings")
    # hubs with more tokens than a block holds are parted by size: similar sets are in one class or in neighbouring ones
    # sums are written before they are joined to the rows of their hub, so that a large hub's join can be split
    sums = materialize(meetings.groupBy("hub").agg(F.count("*").alias("nodes"), F.sum("n").alias("tokens")).filter("nodes > 1"), "sums")
    several = meetings.join(sums, "hub")
    kind = F.floor(F.log("n") / math.log(4 / 3) + 1e-9)
    large = several.filter(F.col("tokens") > BLOCK_TOKENS).select("node", "n", F.explode(F.array(F.xxhash64("hub", kind), F.xxhash64("hub", kind + 1))).alias("hub"))
    groups = several.filter(F.col("tokens") <= BLOCK_TOKENS).select("hub", "node", "n").unionByName(large.select("hub", "node", "n"))
    groups = materialize(groups, "groups")
    hubs = groups.groupBy("hub").agg(F.ceil(F.sum("n") / FIRST_TOKENS).alias("blocks"), F.ceil(F.sum("n") / BLOCK_TOKENS).alias("wide"), F.min("node").alias("pivot"), F.count("*").alias("nodes")).filter("nodes > 1").drop("nodes")
    hubs = materialize(hubs, "hubs")
    placed = groups.select("hub", "node").join(hubs, "hub").withColumn("x", F.when(F.col("node") == F.col("pivot"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), "blocks")))
    pivots = placed.filter("x < 0").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = materialize(placed.filter("x >= 0").unionByName(pivots), "blocks")

    def compared(rows: DataFrame) -> DataFrame:
        rows = materialize(rows, "cells")
        wanted = materialize(first.join(rows.select("node").distinct(), "node"), "wanted")
        found = text.mapInArrow(_texts(_filter_of(wanted.select("doc_id"))), "node long, text string")
        texts = found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        full = rows.join(texts, "node").select("hub", "x", "y", "node", "text", "asks")
        out = materialize(full.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y", "node").mapInArrow(_in_blocks, "a long, b long"), "links")
        release(rows, wanted)
        return out

    links = compared(spread.select("hub", "node", "x", F.lit(0).alias("y"), F.lit(True).alias("asks")))
    comps = components(links)
    # groups of several blocks: nodes outside the pivot's component against all blocks
    cut = spread.filter("blocks > 1").join(comps, "node", "left").select("hub", "node", "pivot", "wide", F.coalesce("comp", "node").alias("comp"))
    main = cut.filter("node = pivot").select("hub", F.col("comp").alias("main")).distinct()
    rest = materialize(cut.join(main, "hub").filter("comp <> main").select("hub", "node", "wide").distinct(), "rest")
    if not rest.isEmpty():
        sizes = materialize(groups.join(rest, ["hub", "node"]).groupBy("hub", "wide").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts")), "parts")
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        asking = rest.join(sizes, ["hub", "wide"]).select("hub", "node", each("wide").alias("x"), F.pmod(F.xxhash64("node", F.lit(1)), "parts").alias("y"), F.lit(True).alias("asks"))
        asked = groups.join(sizes, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), "wide").alias("x"), each("parts").alias("y"), F.lit(False).alias("asks"))
        asked = asked.join(asking.select("hub", "node", "x", "y"), ["hub", "node", "x", "y"], "left_anti")
        more = compared(asking.unionByName(asked))
        release(comps)
        comps = components(links.unionByName(more))
        release(more, sizes)
    release(rest)
    of_node = materialize(first.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "classes")
    release(first, meetings, sums, hubs, groups, spread, links, comps)
    return known.join(of_node, "node", "left")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    A-Z are folded to a-z; shingles are five words, or all words of a shorter text; two texts link at a Jaccard similarity of
    3/4 or more, and component_id is the smallest doc_id that links reach. A null, empty or wordless text has no shingles and
    its own component. Rows are documents by their own text, whatever their ids: rows that repeat a doc_id with one text or several
    each get the component of their text. A null doc_id is never the smallest; a component of null ids only has a null one. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = materialize(_classes(docs, id_col, text_col), "rows")
    # of components of several rows; written before it is joined to them, so that a large one's join can be split
    least = rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    least = materialize(least, "least")
    return rows.join(least, "comp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of jaccard_classes the row of the smallest doc_id, and all rows without shingles.

    If several rows of a component have that doc_id, one stays: by hashes of the text, then the least by all columns.
    """
    rows = materialize(_classes(docs, id_col, text_col), "rows")
    best = rows.filter("comp is not null").groupBy("comp", "doc_id", "h1", "h2").agg(F.count("*").alias("rows"))
    best = best.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "rows")).alias("k")).select("k.doc_id", "k.h1", "k.h2", (F.col("k.rows") > 1).alias("once"))
    plain = rows.filter("comp is null").select("doc_id", "h1", "h2", F.lit(False).alias("once")).distinct()
    return keep_rows(docs, id_col, text_hashes(F.col(text_col)), best.unionByName(plain))
