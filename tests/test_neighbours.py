"""Neighbour search against brute force, and oversampling properties."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowguard.operators import neighbours
from flowguard.operators.balance import oversample
from flowguard.operators.neighbours import nearest_neighbours
from flowguard.sources.tables import VEC_FEATURES, vec_rows


def brute(pdf, features, k):
    x, ids = pdf[features].to_numpy(float), pdf["id"].to_numpy()
    out = set()
    for i in range(len(pdf)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j])) for r, j in enumerate(order)}
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    # A third of the rows are copies of one point; the rest lies in clusters of integer points.
    i = F.col("id")
    x = F.when(i % 3 == 0, 5).otherwise((i * 7919) % 101 + 100 * (i % 4))
    y = F.when(i % 3 == 0, 5).otherwise((i * 104729) % 97)
    return spark.range(900).select("id", x.cast("double").alias("x"), y.cast("double").alias("y"))


@pytest.mark.parametrize("block", [40, 250, 5000])
def test_same_neighbours_as_brute_force(clustered, block):
    got = {(r.id, r.rank, r.neighbour) for r in nearest_neighbours(clustered, "id", ["x", "y"], 4, block_rows=block).collect()}
    assert got == brute(clustered.toPandas(), ["x", "y"], 4)


def test_neighbours_stay_in_their_group(clustered):
    near = nearest_neighbours(clustered.withColumn("g", F.col("id") % 2), "id", ["x", "y"], 2, by="g", block_rows=200)
    assert near.where((F.col("id") % 2) != (F.col("neighbour") % 2)).isEmpty()
    assert near.count() == 1800


def _numbers(spark, n, width, seed):
    x = np.random.default_rng(seed).normal(size=(n, width))
    columns = [f"f{j}" for j in range(width)]
    return spark.createDataFrame([(i, i % 3, *map(float, row)) for i, row in enumerate(x)], ["id", "g", *columns]), columns


def test_a_vector_is_written_once_however_many_cells_it_visits(spark, monkeypatch):
    kept = {}

    def keep(df, purpose):
        kept[purpose] = write_through(df, purpose)
        return kept[purpose]

    write_through = neighbours.write_through
    monkeypatch.setattr(neighbours, "write_through", keep)
    df, columns = _numbers(spark, 600, 24, 1)
    got = {(r.id, r.rank, r.neighbour) for r in nearest_neighbours(df, "id", columns, 3, block_rows=50).collect()}
    assert got == brute(df.toPandas(), columns, 3)
    assert kept["knn-visits"].count() == 600


def test_large_groups_share_their_jobs(spark, monkeypatch):
    calls = []
    search = neighbours._pivot_search
    monkeypatch.setattr(neighbours, "_pivot_search", lambda *a: calls.append(1) or search(*a))
    df, columns = _numbers(spark, 600, 4, 2)
    got = {(r.id, r.rank, r.neighbour) for r in nearest_neighbours(df, "id", columns, 3, by="g", block_rows=50).collect()}
    pdf = df.toPandas()
    assert got == set().union(*(brute(part, columns, 3) for _, part in pdf.groupby("g")))
    assert len(calls) == 1


def test_values_that_are_not_finite_are_farthest(spark):
    df, columns = _numbers(spark, 300, 3, 3)
    odd = df.withColumn("f1", F.when(F.col("id") % 60 == 7, float("nan")).when(F.col("id") == 11, None).otherwise(F.col("f1")))
    rows = {(r.id, r.rank, r.neighbour) for r in nearest_neighbours(odd, "id", columns, 4, block_rows=40).collect()}
    far = {7, 11, 67, 127, 187, 247}
    pdf = df.toPandas()
    assert {r for r in rows if r[0] not in far} == brute(pdf[~pdf["id"].isin(far)].reset_index(drop=True), columns, 4)
    assert {r for r in rows if r[0] == 7} == {(7, 1, 0), (7, 2, 1), (7, 3, 2), (7, 4, 3)}


def test_few_rows(spark):
    two = spark.createDataFrame([(1, 0.0), (2, 3.0)], "id bigint, x double")
    assert {(r.id, r.neighbour) for r in nearest_neighbours(two, "id", ["x"], 5).collect()} == {(1, 2), (2, 1)}
    assert nearest_neighbours(two.limit(1), "id", ["x"], 5).count() == 0


def test_oversampling_levels_classes_on_segments(spark, folder):
    df = vec_rows(spark, folder)
    out = oversample(df, "label", "vec_id", VEC_FEATURES).cache()
    counts = {r["count"] for r in out.groupBy("label").count().collect()}
    assert len(counts) == 1
    new = out.where("copy is not null").toPandas()
    old = df.toPandas()
    for _, row in new.head(20).iterrows():
        mates = old[(old["label"] == row["label"])]
        base = mates[mates["vec_id"] == row["vec_id"]][VEC_FEATURES].to_numpy()[0]
        step = row[VEC_FEATURES].to_numpy(float) - base
        others = mates[mates["vec_id"] != row["vec_id"]][VEC_FEATURES].to_numpy() - base
        # On a segment: parallel to some (neighbour − base), between 0 and 1 times as long.
        u = others @ step / (others * others).sum(axis=1)
        off = np.abs(others * u[:, None] - step).max(axis=1)
        assert off.min() < 1e-9 and -1e-9 <= u[off.argmin()] <= 1 + 1e-9


def test_a_class_of_one_row_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0), (3, 1, 5.0)], "id bigint, y int, x double")
    with pytest.raises(ValueError):
        oversample(df, "y", "id", ["x"])


def _tile(x, q, k, bound=np.inf):
    """Neighbour lists of ``q`` in a tile of one cell that holds ``x``."""
    cells = neighbours._Cells(x[:1], np.array([0, 1]))
    cell, reach = cells.assign(0, x)
    cells.size[0], cells.radius[0] = len(x), max(reach.max(), cells.assign(0, q)[1].max())
    members = pa.table({"cell": pa.array(cell, pa.int32()), "ids": pa.array([[i] for i in range(len(x))]), "x": pa.array(list(x))})
    visitors = pa.table({"cell": pa.array(np.zeros(len(q)), pa.int32()), "node": np.arange(len(q)), "x": pa.array(list(q)),
                         "bound": np.full(len(q), bound)})
    out = neighbours._tile_search(cells, x.shape[1], k)(visitors, members)
    return [[(e["d2"], e["neighbour"]) for e in near] for near in out.column("near").to_pylist()]


def _nearest(x, q, k):
    d2 = neighbours.squared_distances(q, x)
    return [[(d2[i, j], j) for j in np.lexsort((np.arange(len(x)), d2[i]))[: k + 1].tolist()] for i in range(len(q))]


@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 1e7), (1e140, 0), (1e-140, 0)])
def test_a_tile_is_searched_in_single_precision(monkeypatch, scale, shift):
    x, q = (np.random.default_rng(i).normal(size=(n, 24)) * scale + shift for i, n in ((1, 3000), (2, 200)))
    wanted = _nearest(x, q, 5)
    monkeypatch.setattr(neighbours, "_closest", None)  # double precision is not asked
    assert _tile(x, q, 5) == wanted


def test_close_vectors_of_far_clusters_are_told_apart_in_double_precision():
    r = np.random.default_rng(3)
    x = r.normal(size=(5, 8))[r.integers(0, 5, 3000)] * 1e4 + r.normal(size=(3000, 8)) * 1e-4
    assert _tile(x, x[:150], 4) == _nearest(x, x[:150], 4)


@pytest.mark.parametrize("n", [1, 5, 6, 97])
def test_tiles_of_few_vectors(n):
    x = np.random.default_rng(n).integers(0, 3, size=(n, 2)).astype(float)
    assert _tile(x, x, 5) == _nearest(x, x, 5)
