"""Extremely randomised trees: random cuts between the smallest and largest value in a node, best of a few.

Trees grow level by level, several at once. A level takes two aggregates over the rows: the range of each
candidate feature in each open node, then the class counts left of one random cut per candidate. Rows keep no
state between levels; tasks send them down the broadcast trees. Counts are merged inside a task before the
shuffle, so no node, however large, is one task's group.

Features and cuts of a node follow from a hash of ``(seed, tree, path)``: equal rows give equal trees, whatever
their order and partitions. What the driver holds is the open nodes of ``at_once`` trees, at most one per
``2 * min_leaf`` rows and tree, hence bounded by the caller's sample.

Defined cases: null and NaN count as missing, take no part in ranges and go right at every cut; infinities count
as the largest doubles; rows without a label teach nothing; without rows, or with one class, every tree is a leaf
and all importances are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT_ONCE = 10  # trees grown in one set of passes
LARGEST = np.finfo(np.float64).max


def mix(value: np.ndarray) -> np.ndarray:
    """64-bit finaliser (shift, multiply) of unsigned integers."""
    z = np.asarray(value, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        z += np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def root_keys(seed: int, trees: int) -> np.ndarray:
    return mix(mix(np.full(trees, seed % (1 << 63), dtype=np.uint64)) ^ np.arange(trees, dtype=np.uint64))


def child_key(key: np.ndarray, side: int) -> np.ndarray:
    return mix(key ^ np.uint64(side + 1))


def feature_draws(key: np.ndarray, n_features: int) -> np.ndarray:
    """A hash per node and feature; the smallest ones are the node's candidates."""
    return mix(mix(key)[:, None] ^ np.arange(1, n_features + 1, dtype=np.uint64)[None, :])


def cut_between(lo: np.ndarray, hi: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A point in ``[lo, hi)``, uniform in the hash."""
    u = (mix(draw) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.maximum(lo, np.minimum(lo * (1 - u) + hi * u, np.nextafter(hi, -np.inf)))


def impurity(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity, over the last axis."""
    n = counts.sum(-1)
    return n - (counts * counts).sum(-1) / np.maximum(n, 1)


@dataclass
class Tree:
    """Nodes in order of birth; ``child`` is the left child, the right one follows it. Leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    counts: np.ndarray

    def leaves(self) -> np.ndarray:
        return self.counts[self.feature < 0]

    def importances(self, n_features: int) -> np.ndarray:
        """Impurity removed by each feature, as shares of the tree's total."""
        at = np.flatnonzero(self.feature >= 0)
        left, right = self.counts[self.child[at]], self.counts[self.child[at] + 1]
        gain = np.maximum(impurity(self.counts[at]) - impurity(left) - impurity(right), 0)
        out = np.bincount(self.feature[at], weights=gain, minlength=n_features)
        return out / out.sum() if out.sum() > 0 else out


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Node number of every row."""
    at, live = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while True:
        live = live[tree.feature[at[live]] >= 0]
        if not len(live):
            return at
        node = at[live]
        at[live] = tree.child[node] + ~(x[live, tree.feature[node]] <= tree.cut[node])


def _matrix(batch, n_features: int) -> np.ndarray:
    x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n_features)], 1)
    return np.clip(x, -LARGEST, LARGEST)


def _in_open_nodes(trees, open_slot, batch, n_features):
    """Per tree: the rows in open nodes and their slots, in order of the slot; and the rows' features."""
    x = _matrix(batch, n_features)
    for tree, slot_of in zip(trees, open_slot):
        slot = slot_of[descend(tree, x)]
        rows = np.flatnonzero(slot >= 0)
        rows = rows[np.argsort(slot[rows], kind="stable")]
        if len(rows):
            yield x, rows, slot[rows]


def _ranges(rows: DataFrame, shared, n_features: int) -> DataFrame:
    def run(batches):
        trees, open_slot, candidates = shared.value
        k = candidates.shape[1]
        for batch in batches:
            for x, at, slot in _in_open_nodes(trees, open_slot, batch, n_features):
                first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                for j in range(k):
                    feature = candidates[slot, j]
                    value = np.where(feature >= 0, x[at, feature], np.nan)
                    lo, hi = np.fmin.reduceat(value, first), np.fmax.reduceat(value, first)
                    seen = ~np.isnan(lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot[first][seen] * k + j), pa.array(lo[seen]), pa.array(hi[seen])], names=["cell", "lo", "hi"])

    return rows.mapInArrow(run, "cell long, lo double, hi double").groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _left_counts(rows: DataFrame, shared, n_features: int, n_classes: int) -> DataFrame:
    def run(batches):
        trees, open_slot, candidates, cuts = shared.value
        k = candidates.shape[1]
        for batch in batches:
            y = batch.column(n_features).to_numpy(zero_copy_only=False)
            for x, at, slot in _in_open_nodes(trees, open_slot, batch, n_features):
                for j in range(k):
                    left = x[at, candidates[slot, j]] <= cuts[slot, j]
                    cell, n = np.unique((slot[left] * k + j) * n_classes + y[at[left]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class _Growing:
    """One tree while it grows: its nodes as lists, and the numbers of the open ones."""

    def __init__(self, counts: np.ndarray, key: np.uint64, n_features: int):
        self.feature, self.cut, self.child, self.counts = [-1], [np.nan], [-1], [counts]
        self.key, self.depth = [key], [0]
        self.open, self.constant = [0], {0: np.zeros(n_features, dtype=bool)}

    def tree(self) -> Tree:
        return Tree(np.array(self.feature), np.array(self.cut), np.array(self.child), np.array(self.counts))

    def splittable(self, node: int, depth: int | None, min_leaf: int) -> bool:
        counts = self.counts[node]
        return (counts.sum() >= 2 * min_leaf and counts.max() < counts.sum() and not self.constant[node].all()
                and (depth is None or self.depth[node] < depth))

    def split(self, node: int, feature: int, cut: float, left: np.ndarray) -> None:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, first
        for side, counts in enumerate((left, self.counts[node] - left)):
            self.feature.append(-1), self.cut.append(np.nan), self.child.append(-1), self.counts.append(counts)
            self.key.append(child_key(np.uint64(self.key[node]), side)[()])
            self.depth.append(self.depth[node] + 1)
            # What is constant in a node is constant below it.
            self.constant[first + side] = self.constant[node].copy()
            self.open.append(first + side)


def _grow(rows: DataFrame, growing: list[_Growing], n_features: int, n_classes: int, k: int, depth, min_leaf: int) -> None:
    context = rows.sparkSession.sparkContext
    while True:
        for g in growing:
            g.open = [n for n in g.open if g.splittable(n, depth, min_leaf)]
        slots = [(g, n) for g in growing for n in g.open]
        if not slots:
            return
        for g in growing:
            g.constant = {n: g.constant[n] for n in g.open}
        trees, open_slot, base = [g.tree() for g in growing], [], 0
        for g in growing:
            slot_of = np.full(len(g.feature), -1, dtype=np.int64)
            slot_of[g.open] = base + np.arange(len(g.open))
            base += len(g.open)
            open_slot.append(slot_of)
        draws = feature_draws(np.array([g.key[n] for g, n in slots], dtype=np.uint64), n_features)
        constant = np.array([g.constant[n] for g, n in slots])
        order = np.lexsort((draws, constant), axis=1)[:, :k]
        candidates = np.where(np.take_along_axis(constant, order, 1), -1, order)

        shared = context.broadcast((trees, open_slot, candidates))
        got = _ranges(rows, shared, n_features).toPandas()
        shared.unpersist()
        lo, hi = np.full(candidates.size, np.nan), np.full(candidates.size, np.nan)
        cell = got["cell"].to_numpy()
        lo[cell], hi[cell] = got["lo"], got["hi"]
        lo, hi = lo.reshape(candidates.shape), hi.reshape(candidates.shape)
        varies = (candidates >= 0) & (lo < hi)
        cuts = np.where(varies, cut_between(lo, hi, np.take_along_axis(draws, order, 1)), np.nan)

        shared = context.broadcast((trees, open_slot, candidates, cuts))
        got = _left_counts(rows, shared, n_features, n_classes).toPandas()
        shared.unpersist()
        left = np.zeros(candidates.size * n_classes, dtype=np.int64)
        left[got["cell"].to_numpy()] = got["n"]
        left = left.reshape(*candidates.shape, n_classes)
        total = np.array([g.counts[n] for g, n in slots])
        right = total[:, None, :] - left
        gain = impurity(total)[:, None] - impurity(left) - impurity(right)
        gain[~varies | (left.sum(-1) < min_leaf) | (right.sum(-1) < min_leaf)] = -np.inf
        best = gain.argmax(1)  # of equal gains the first drawn

        for g in growing:
            g.open = []
        for s, (g, node) in enumerate(slots):
            j = best[s]
            flat = candidates[s][(candidates[s] >= 0) & ~varies[s]]
            g.constant[node][flat] = True
            if gain[s, j] > -np.inf:
                g.split(node, int(candidates[s, j]), float(cuts[s, j]), left[s, j])
            elif not varies[s].any():
                g.open.append(node)  # only constant features were drawn: others get their turn


def _numbered(rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).select(
        *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)], F.col(label).cast("long").alias("_y"))


def fit_extra_trees(
    rows: DataFrame, cols: list[str], label: str, trees: int = 100, depth: int | None = None, min_leaf: int = 5,
    candidates: int | None = None, seed: int = 42, at_once: int = AT_ONCE,
) -> list[Tree]:
    """Trees on all of ``rows``, which every pass reads again, so it should be a written table.

    ``label`` holds class numbers from 0; ``candidates`` features are tried per node (default: the whole part of the
    square root of their number); no ``depth`` means until nothing can be split.
    """
    given = _numbered(rows, cols, label)
    per_class = {r["_y"]: r["n"] for r in given.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # one row per class
    n_classes = max(per_class, default=0) + 1
    counts = np.array([per_class.get(c, 0) for c in range(n_classes)], dtype=np.int64)
    k = min(len(cols), candidates or max(1, int(len(cols) ** 0.5)))
    growing = [_Growing(counts, key, len(cols)) for key in root_keys(seed, trees)]
    for first in range(0, trees, at_once):
        _grow(given, growing[first: first + at_once], len(cols), n_classes, k, depth, min_leaf)
    return [g.tree() for g in growing]


def extra_tree_importance(grown: list[Tree], n_features: int) -> np.ndarray:
    """Mean over the trees of each one's shares; sums to 1 unless every tree is a leaf."""
    mean = np.mean([t.importances(n_features) for t in grown], axis=0) if grown else np.zeros(n_features)
    return mean / mean.sum() if mean.sum() > 0 else mean


def leaf_counts(rows: DataFrame, grown: list[Tree], cols: list[str], label: str) -> DataFrame:
    """``tree, leaf, class, n`` of the labelled rows."""
    shared, n_features = rows.sparkSession.sparkContext.broadcast(grown), len(cols)

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch, n_features), batch.column(n_features).to_numpy(zero_copy_only=False)
            for t, tree in enumerate(shared.value):
                pairs, n = np.unique(np.stack([descend(tree, x), y], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), t)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)],
                    names=["tree", "leaf", "class", "n"])

    counted = _numbered(rows, cols, label).mapInArrow(run, "tree long, leaf long, class long, n long")
    return counted.groupBy("tree", "leaf", "class").agg(F.sum("n").alias("n"))
