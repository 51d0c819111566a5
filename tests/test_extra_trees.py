"""Extremely randomised trees against plain recursion over lists, and odd inputs."""

import numpy as np
import pytest

from flowguard.operators import extra_trees as E
from flowguard.operators.selection import tree_importance

COLS = ["a", "b", "c", "d"]


def gini(labels):
    n = len(labels)
    return n - sum(labels.count(c) ** 2 for c in set(labels)) / n if n else 0.0


def plain(rows, key, tried, min_leaf, depth, out, total_features):
    """Importances of one tree by recursion; ``tried`` are the features known to be constant here."""
    labels = [y for _, y in rows]
    if len(rows) < 2 * min_leaf or len(set(labels)) < 2 or depth == 0:
        return
    draws = E.feature_draws(np.array([key], dtype=np.uint64), total_features)[0]
    order = sorted((f for f in range(total_features) if f not in tried), key=lambda f: draws[f])
    k = int(total_features ** 0.5)
    best, constant = None, set(tried)
    for first in range(0, len(order), k):
        seen = False
        for f in order[first: first + k]:
            values = [x[f] for x, _ in rows if not np.isnan(x[f])]
            if not values or min(values) == max(values):
                constant.add(f)
                continue
            seen = True
            cut = E.cut_between(np.array(min(values)), np.array(max(values)), draws[f])
            left, right = [r for r in rows if r[0][f] <= cut], [r for r in rows if not r[0][f] <= cut]
            if min(len(left), len(right)) < min_leaf:
                continue
            gain = gini(labels) - gini([y for _, y in left]) - gini([y for _, y in right])
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, left, right
        if seen:
            break
    if best is None:
        return
    gain, f, left, right = best
    out[f] += max(gain, 0)
    for side, part in enumerate((left, right)):
        plain(part, E.child_key(np.uint64(key), side)[()], constant, min_leaf, None if depth is None else depth - 1, out, total_features)


def table(spark, rows):
    return spark.createDataFrame([(*[float(v) for v in x], y) for x, y in rows], "a double, b double, c double, d double, y long")


@pytest.mark.parametrize("depth", [None, 3])
def test_same_importances_as_recursion(spark, depth):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x = [rng.normal(), float(rng.integers(0, 3)), 7.0, rng.normal() * 100]
        y = int(x[0] + 0.4 * x[1] > 0.5) + int(x[3] > 60)
        if i % 29 == 0:
            x[0] = float("nan")
        rows.append((x, y))
    df = table(spark, rows).repartition(5)
    grown = E.fit_extra_trees(df, COLS, "y", trees=4, depth=depth, seed=9, at_once=3)
    for tree, key in zip(grown, E.root_keys(9, 4)):
        want = np.zeros(4)
        plain(rows, key, set(), 5, depth, want, 4)
        assert np.allclose(tree.importances(4), want / (want.sum() or 1.0), atol=1e-9)
    assert sum(len(t.feature) > 9 for t in grown) >= 2
    assert grown[0].importances(4)[2] == 0.0
    leaves = E.leaf_counts(df, grown, COLS, "y").collect()
    for t, tree in enumerate(grown):
        got = np.zeros_like(tree.counts)
        for r in leaves:
            if r.tree == t:
                got[r.leaf, r["class"]] = r.n
        assert (got[tree.feature < 0] == tree.leaves()).all() and got.sum() == 400


def test_trees_do_not_depend_on_partitions_or_batches_of_trees(spark):
    rng = np.random.default_rng(6)
    rows = [(list(rng.normal(size=4)), int(rng.integers(0, 2))) for _ in range(200)]
    first = E.fit_extra_trees(table(spark, rows).coalesce(1), COLS, "y", trees=3, at_once=1)
    other = E.fit_extra_trees(table(spark, rows[::-1]).repartition(7), COLS, "y", trees=3)
    assert all((a.feature[0] == b.feature[0]) and a.cut[0] == b.cut[0] and len(a.cut) == len(b.cut) for a, b in zip(first, other))
    assert np.allclose(E.extra_tree_importance(first, 4), E.extra_tree_importance(other, 4))


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([inf, nan, 1, -inf], 0)] * 20 + [([-inf, nan, 1, inf], 1)] * 20
    grown = E.fit_extra_trees(table(spark, rows), COLS, "y", trees=3)
    assert all(len(t.feature) == 3 for t in grown)  # one cut, whichever useful feature comes first
    null = spark.createDataFrame([(None, None, None, None, None)] * 3, "a double, b double, c double, d double, y long")
    for df in (null, null.limit(0), table(spark, rows[:20])):
        grown = E.fit_extra_trees(df, COLS, "y", trees=2)
        assert [len(t.feature) for t in grown] == [1, 1] and E.extra_tree_importance(grown, 4).sum() == 0
    assert E.fit_extra_trees(table(spark, rows), COLS, "y", trees=0) == []


def test_mean_of_both_forests(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, y + rng.normal() * 0.1, rng.normal(), y))
    df = spark.createDataFrame(rows, "id long, useful double, noise double, y int")
    shares = tree_importance(df, ["useful", "noise"], "y", "id", trees=10, depth=4)
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["useful"] > 0.8
