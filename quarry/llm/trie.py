"""Similarity join of a bounded block of sets over a prefix tree."""

from __future__ import annotations

import numpy as np


class Groups:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Node:
    """A run of tokens that the sets below share. ends: sets whose last shared token it is."""

    __slots__ = ("label", "kids", "ends", "low", "high", "deep", "one")

    def __init__(self, label):
        self.label, self.kids, self.ends, self.one = label, [], [], False


def _tree(rows: list[np.ndarray], order: list[int], sizes: list[int]) -> Node:
    """Prefix tree of the rows, which come in lexical order. low, high: sizes below; deep: most tokens below the node's end."""
    root = Node(rows[0][:0])
    path, depths, last = [root], [0], None
    for i in order:
        row = rows[i]
        if last is None:
            same = 0
        else:
            m = min(len(last), len(row))
            differ = np.flatnonzero(last[:m] != row[:m])
            same = int(differ[0]) if len(differ) else m
        while depths[-1] > same:
            if depths[-2] < same:  # the run is split where the sets part
                node = path[-1]
                above = Node(node.label[: same - depths[-2]])
                node.label = node.label[same - depths[-2] :]
                path[-2].kids[-1] = above
                above.kids.append(node)
                path[-1], depths[-1] = above, same
            else:
                path.pop()
                depths.pop()
        if len(row) > same:
            node = Node(row[same:])
            path[-1].kids.append(node)
            path.append(node)
            depths.append(len(row))
        path[-1].ends.append(i)
        last = row
    stack, done = [root], []
    while stack:
        node = stack.pop()
        done.append(node)
        stack += node.kids
    for node in reversed(done):
        own = [sizes[i] for i in node.ends]
        node.low = min(own + [k.low for k in node.kids])
        node.high = max(own + [k.high for k in node.kids])
        node.deep = max([0] + [k.deep + len(k.label) for k in node.kids])
    return root


def similar_groups(sets: list[np.ndarray], num: int = 3, den: int = 4, asks: list[bool] | None = None) -> Groups:
    """Joins i and j if num * union <= den * intersection. asks: compare only pairs of which one asks.

    Tokens are ordered by how many sets of the block hold them, most first, so that similar sets share long paths. A set walks
    down the tree and carries its overlap with the path, which all sets below share. A subtree goes when its remaining length,
    or the remaining tokens of the set, can't lift the overlap to what its smallest member needs. Tokens of a single set can't
    overlap and count in sizes only. Subtrees that are already in the set's group are skipped.
    """
    groups = Groups(len(sets))
    if len(sets) < 2:
        return groups
    sizes = [len(s) for s in sets]
    _, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    shared = int((count > 1).sum())
    rows, at = [], 0
    for n in sizes:
        own = rank[where[at : at + n]]
        rows.append(np.sort(own[own < shared]))
        at += n
    # den * overlap >= num * (a + b - overlap), and overlap <= smaller set
    live = [i for i, n in enumerate(sizes) if n and den * len(rows[i]) >= num * n]
    if len(live) < 2:
        return groups
    root = _tree(rows, sorted(live, key=lambda i: rows[i].astype(">i4").tobytes()), sizes)
    mark = np.zeros(shared + 1, dtype=bool)
    for i in live:
        if asks is not None and not asks[i]:
            continue
        row, n = rows[i], sizes[i]
        mark[row] = True
        stack = [(root, 0, False)]
        while stack:
            node, have, after = stack.pop()
            if after:
                ends = [groups.find(x) for x in node.ends] + [groups.find(_any(k)) for k in node.kids]
                node.one = len(set(ends)) == 1 and all(k.one for k in node.kids)
                continue
            if node.one and groups.find(_any(node)) == groups.find(i):
                continue
            if num * n > den * node.high or num * node.low > den * n:
                continue
            if len(node.label):
                have += int(np.count_nonzero(mark[node.label]))
                rest = len(row) - int(np.searchsorted(row, node.label[-1], side="right"))
            else:
                rest = len(row)
            if (den + num) * (have + min(rest, node.deep)) < num * (n + node.low):
                continue
            for j in node.ends:
                if j != i and (den + num) * have >= num * (n + sizes[j]):
                    groups.join(i, j)
            stack.append((node, have, True))
            stack += [(k, have, False) for k in node.kids]
        mark[row] = False
    return groups


def _any(node: Node) -> int:
    while not node.ends:
        node = node.kids[0]
    return node.ends[0]
