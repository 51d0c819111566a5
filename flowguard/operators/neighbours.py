"""Exact k nearest neighbours within a set of rows, pruned by pivots.

Rows are collapsed to distinct vectors (copies keep their smallest ids, which is all a neighbour
list can use) and vectors are assigned to the nearest of a bounded number of pivots. Cells that lie
together make tiles of bounded size, and a vector goes once to each tile that can hold something
closer than what it already knows. A tile meets its visitors in bounded parts; a chunk of visitors is
held against the cells it needs by one matrix product in single precision (in double precision where that
tells too little apart), which leaves out what is too far by more than its rounding error, and the rest
is measured feature by feature. No pair list is ever written: a tile
returns one list of at most k+1 entries per visitor. All large groups go through the same jobs.

Vectors that are not finite have a cell of their own, which every vector of their group visits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.functions.numbers import scatter
from flowguard.session import write_through

BLOCK_ROWS = 2000
MAX_PIVOTS = 4096
SLACK = 1e-9  # distances are compared with this much relative tolerance, towards visiting more
ROUNDING = 1e-12  # error of a product form of a squared distance, relative to the squared lengths
LARGEST = 1e150  # beyond it a square may overflow; such values count as not finite
TILE_ROWS, TILE_VALUES = 32768, 1 << 21  # vectors of a tile, and their numbers
PART_ROWS = 16384  # visitors that meet a tile in one task
CHUNK_ROWS = 128  # visitors that are multiplied with a tile at once
BLOCK_VECTORS = 2048  # vectors of a tile that are multiplied at once
SINGLE_ROUNDING = 1.2e-7  # as ROUNDING, for single precision, a feature
SINGLE_PAIRS = 32  # pairs left of each one wanted, from which on double precision decides


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|a_i − b_j|², summed feature by feature (same order as a column expression)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None, :]
        out += d * d
    return out


def _as_vector(features: list[str]):
    return F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features])


def _vectors(rows: DataFrame, k: int) -> DataFrame:
    """``g, x, ids``: distinct vectors of each group with their k+1 smallest ids."""
    first = W.partitionBy("g", "x").orderBy("id")
    few = rows.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k + 1)
    tame = F.coalesce(F.forall("x", lambda v: F.abs(v) < LARGEST), F.lit(False))
    return few.groupBy("g", "x").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("tame", tame)


def _joined(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _matrix(column, width: int) -> np.ndarray:
    flat = _joined(column).flatten()  # nulls become NaN
    return flat.to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(-1, width)


def _product_form(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|a_i − b_j|² by a matrix product, and how far each row may be off."""
    out = a @ b.T
    out *= -2.0
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    out += aa[:, None]
    out += bb[None, :]
    return out, ROUNDING * (aa + (bb.max() if len(bb) else 0.0)) * max(1, a.shape[1] / 64)


class _Cells:
    """Pivots and cells of all groups. Cell ``len(pivots) + g`` holds what is not finite in group ``g``."""

    def __init__(self, pivots: np.ndarray, first: np.ndarray):
        self.pivots, self.first = pivots, first  # group g has the pivots first[g] .. first[g + 1] − 1
        self.size = np.zeros(len(pivots) + len(first) - 1, dtype="int64")
        self.radius = np.zeros(len(self.size))

    def assign(self, g: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot, for finite vectors of a group."""
        lo, hi = self.first[g], self.first[g + 1]
        cell = _product_form(x, self.pivots[lo:hi])[0].argmin(axis=1) + lo
        off = np.zeros(len(x))
        for j in range(x.shape[1]):
            off += (x[:, j] - self.pivots[cell, j]) ** 2
        return cell, np.sqrt(off)

    def distances(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds from below and above on the distance to the members of some cells of pivots."""
        d2, off = _product_form(x, self.pivots[cells])
        near = np.sqrt(np.maximum(d2 - off[:, None], 0.0)) - self.radius[cells][None, :] * (1 + SLACK)
        return near, np.sqrt(np.maximum(d2, 0.0) + off[:, None]) + self.radius[cells][None, :]

    def tiles(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """First tile of each cell, and over how many tiles its members are dealt.

        The cells of a group are halved along the widest feature of their pivots until a part fits.
        """
        first, spread, n = np.zeros(len(self.size), dtype="int64"), np.ones(len(self.size), dtype="int64"), 0
        own = [np.arange(a, b) for a, b in zip(self.first, self.first[1:])]
        todo = [c[self.size[c] > 0] for c in own] + [np.array([c]) for c in range(len(self.pivots), len(self.size))]
        while todo:
            cells = todo.pop()
            total = self.size[cells].sum()
            if not total:
                continue
            if len(cells) > 1 and total > rows:
                by = cells[self.pivots[cells][:, np.ptp(self.pivots[cells], axis=0).argmax()].argsort(kind="stable")]
                cut = 1 + int(np.searchsorted(self.size[by][:-1].cumsum()[:-1], total / 2))
                todo += [by[cut:], by[:cut]]
                continue
            first[cells], spread[cells] = n, -(-total // rows) if len(cells) == 1 else 1
            n += int(spread[cells[0]])
        return first, spread


def _place(cells: _Cells, width: int):
    def run(batches):
        for b in batches:
            x, tame, g = _matrix(b.column("x"), width), b.column("tame").to_numpy(zero_copy_only=False), b.column("g").to_numpy()
            cell, reach = len(cells.pivots) + g.astype("int64"), np.full(len(x), np.inf)
            for group in np.unique(g):
                on = np.flatnonzero((g == group) & tame)
                for at in range(0, len(on), CHUNK_ROWS):
                    part = on[at:at + CHUNK_ROWS]
                    cell[part], reach[part] = cells.assign(group, x[part])
            yield pa.RecordBatch.from_arrays(
                [b.column("g"), b.column("x"), b.column("ids"), pa.array(cell.astype("int32")), pa.array(reach)],
                names=["g", "x", "ids", "cell", "reach"])

    return run


def _visits(cells: _Cells, first: np.ndarray, spread: np.ndarray, width: int, k: int):
    """Of one block of a cell: how far the k-th other vector may be, and the tiles to look into."""
    n_tiles, seen = int((first + spread).max()), {}

    def reached_by(g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of pivots with members, the tiles of each, and the tiles of what is not finite."""
        if g not in seen:
            lo, hi, rest = cells.first[g], cells.first[g + 1], len(cells.pivots) + g
            known = np.arange(lo, hi)[cells.size[lo:hi] > 0]
            at, always = np.arange(n_tiles), np.zeros(n_tiles, dtype=bool)
            inside = (at >= first[known][:, None]) & (at < (first + spread)[known][:, None])
            if cells.size[rest]:
                always[first[rest]:first[rest] + spread[rest]] = True
            seen.clear()
            seen[g] = known, inside.astype("float32"), always
        return seen[g]

    def run(b: pa.Table) -> pa.Table:
        x, g, own = _matrix(b.column("x"), width), b.column("g")[0].as_py(), b.column("cell")[0].as_py()
        rest = len(cells.pivots) + g
        known, reached, always = reached_by(g)
        bound, tiles, counts = np.full(len(x), np.inf), [], []
        for at in range(0, len(x), CHUNK_ROWS):
            q = x[at:at + CHUNK_ROWS]
            if own == rest:
                hit = np.ones((len(q), len(known)), dtype=bool)
            else:
                low, far = cells.distances(q, known)
                if len(x) > k:
                    d2, off = _product_form(q, x)
                    limit = np.sqrt(np.maximum(np.partition(d2, k, axis=1)[:, k], 0.0) + off)  # index 0 is itself
                elif len(known) > k:
                    limit = np.partition(far, k, axis=1)[:, k]  # k+1 cells hold as many vectors
                else:
                    limit = far.max(axis=1) if cells.size[known].sum() > k else np.full(len(q), np.inf)
                bound[at:at + CHUNK_ROWS] = limit
                hit = low <= (limit * (1 + SLACK))[:, None]
            into = ((hit.astype("float32") @ reached) > 0) | always[None, :]
            tiles.append(np.nonzero(into)[1])
            counts.append(into.sum(axis=1))
        ends = np.r_[0, np.concatenate(counts).cumsum()]
        return pa.table({
            "node": b.column("node"), "cell": b.column("cell"), "x": b.column("x"), "bound": pa.array(bound),
            "tiles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tiles), pa.int32())),
        })

    return run


def _ranks(row: np.ndarray) -> np.ndarray:
    """Place of each entry within its row; rows stand together."""
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], at, 0)) if len(row) else at


def _closest(q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, finite: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(row of q, row of x)`` that hold the k+1 nearest of each row, and few others."""
    if finite:
        d2, off = _product_form(q, x)
    else:
        with np.errstate(invalid="ignore", over="ignore"):
            d2, off = squared_distances(q, x), np.zeros(len(q))
        d2[np.isnan(d2)] = np.inf
    limit = bound * bound * (1 + SLACK) + off
    # The smallest of each of some parts are different vectors, so k+1 of them bound the wanted distance.
    step = max(1, len(x) // (16 * (k + 1)))
    if len(x) > k:
        least = np.minimum.reduceat(d2, np.arange(0, len(x), step), axis=1)
        limit = np.minimum(limit, np.partition(least, k, axis=1)[:, k] + 2 * off)
    return np.nonzero(d2 <= limit[:, None])


class _Single:
    """Vectors around a common middle in single precision, for products with any others of that middle and scale.

    Row i holds the vector and its squared length, so that one product gives |x|² − 2 q·x.
    """

    def __init__(self, x: np.ndarray, middle: np.ndarray, scale: float):
        self.middle, self.scale = middle, scale
        x, self.lengths = self.scaled(x)
        self.rows = np.hstack([x, self.lengths[:, None]]).astype("float32")

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x - self.middle) / self.scale
        return y, (y * y).sum(axis=1)

    def closest(self, q: np.ndarray, on: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_closest`` with the vectors ``on``; None where single precision leaves too many pairs."""
        rows, n, width = self.rows if len(on) == len(self.rows) else self.rows[on], len(on), q.shape[1]
        q, own = self.scaled(q)
        off = SINGLE_ROUNDING * (width + 8) * (own + self.lengths[on].max()) + 1e-35
        q = np.hstack([-2.0 * q, np.ones((len(q), 1))]).astype("float32").T.copy()
        # Parts of equal size; the smallest of each are different vectors, so k+1 of them bound the wanted distance.
        step = max(1, min(64, n // (16 * (k + 1))))
        d2 = np.full((-(-n // step) * step, q.shape[1]), np.inf, dtype="float32")
        least = np.empty((len(d2) // step, q.shape[1]), dtype="float32")
        block = step * max(1, BLOCK_VECTORS // step)
        for at in range(0, n, block):
            end = min(at + block, n)
            np.matmul(rows[at:end], q, out=d2[at:end])
            parts = d2[at:at + block].reshape(-1, step, q.shape[1])
            np.min(parts, axis=1, out=least[at // step:at // step + len(parts)])
        limit = (bound / self.scale) ** 2 * (1 + SLACK) - own + off
        if len(least) > k:
            limit = np.minimum(limit, np.partition(least, k, axis=0)[k] + 2 * off)
        with np.errstate(over="ignore"):
            limit = (limit + np.abs(limit) * 2e-7).astype("float32")
        part, i = np.nonzero(least <= limit)
        if len(i) > SINGLE_PAIRS * (k + 1) * len(own):
            return None
        hit, j = np.nonzero(d2.reshape(-1, step, q.shape[1])[part, :, i] <= limit[i][:, None])
        if len(hit) > SINGLE_PAIRS * (k + 1) * len(own):
            return None
        i, j = i[hit], part[hit] * step + j
        real = j < n
        return i[real], j[real]


def _single(x: np.ndarray, q: np.ndarray) -> _Single | None:
    """``x`` for products with ``q``; None if all are the same."""
    middle = x.mean(axis=0)
    scale = np.sqrt(max(((x - middle) ** 2).sum(axis=1).max(), ((q - middle) ** 2).sum(axis=1).max())) if len(q) else 0.0
    return _Single(x, middle, scale) if 0.0 < scale < np.inf else None


def _tile_search(cells: _Cells, width: int, k: int):
    kind = pa.list_(pa.struct([("d2", pa.float64()), ("neighbour", pa.int64())]))

    def run(visitors: pa.Table, members: pa.Table) -> pa.Table:
        if not visitors.num_rows or not members.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], kind)})
        members, visitors = members.sort_by("cell"), visitors.sort_by("cell")
        x, q = _matrix(members.column("x"), width), _matrix(visitors.column("x"), width)
        lists = _joined(members.column("ids"))
        ids, starts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype("int64")
        there, begins = np.unique(members.column("cell").to_numpy(), return_index=True)
        ends, finite = np.r_[begins[1:], len(x)], bool(there[-1] < len(cells.pivots))
        own, bound = visitors.column("cell").to_numpy(), visitors.column("bound").to_numpy()
        node = visitors.column("node").to_numpy()
        out = []
        # Visitors that are not finite come last.
        cut = int(np.searchsorted(own, len(cells.pivots)))
        step = CHUNK_ROWS if finite else CHUNK_ROWS // 4
        chunks = [(a, min(a + step, cut), finite) for a in range(0, cut, step)]
        chunks += [(a, min(a + CHUNK_ROWS // 4, len(q)), False) for a in range(cut, len(q), CHUNK_ROWS // 4)]
        single = _single(x, q[:cut]) if finite else None
        for a, b, plain in chunks:
            on = np.arange(len(x))
            if plain:
                need = (cells.distances(q[a:b], there)[0] <= (bound[a:b] * (1 + SLACK))[:, None]).any(axis=0)
                if not need.all():
                    on = np.concatenate([np.arange(i, j) for i, j in zip(begins[need], ends[need])] or [on[:0]])
            if not len(on):
                continue
            found = single.closest(q[a:b], on, bound[a:b], k) if plain and single else None
            i, j = found or _closest(q[a:b], x if len(on) == len(x) else x[on], bound[a:b], k, plain)
            j = on[j]
            d2 = np.zeros(len(i))
            with np.errstate(invalid="ignore", over="ignore"):
                for f in range(width):  # same order as a column expression
                    d = q[a + i, f] - x[j, f]
                    d2 += d * d
            # Vectors by distance and smallest id, then all their ids alike.
            order = np.lexsort((ids[starts[j]], d2, i))
            order = order[_ranks(i[order]) <= k]
            i, j, d2 = i[order], j[order], d2[order]
            many = starts[j + 1] - starts[j]
            at = np.repeat(starts[j] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            i, d2, other = np.repeat(i, many), np.repeat(d2, many), ids[at]
            order = np.lexsort((other, d2, i))
            order = order[_ranks(i[order]) <= k]
            out.append((a + i[order], d2[order], other[order]))
        i, d2, other = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, "int64"))
        row, at = np.unique(i, return_index=True)
        entries = pa.StructArray.from_arrays([pa.array(d2), pa.array(other)], names=["d2", "neighbour"])
        return pa.table({
            "node": pa.array(node[row]),
            "near": pa.ListArray.from_arrays(pa.array(np.r_[at, len(i)], pa.int32()), entries),
        })

    return run


def _whole_group(k: int):
    """All neighbours of one small group in one task."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        ids, x = b["id"].to_numpy(), np.stack(b["x"].to_numpy())
        take = min(k, len(b) - 1)
        if take < 1:
            return pd.DataFrame({c: np.array([], t) for c, t in (
                ("id", "int64"), ("rank", "int32"), ("neighbour", "int64"), ("d2", "float64"))})
        parts = []
        for at in range(0, len(b), 512):
            d2 = squared_distances(x[at:at + 512], x)
            rows = np.arange(len(d2))
            d2[rows, at + rows] = np.inf  # never itself
            best = np.argsort(d2, axis=1, kind="stable")[:, :take]
            parts.append(pd.DataFrame({
                "id": np.repeat(ids[at:at + 512], take),
                "rank": np.tile(np.arange(1, take + 1), len(d2)).astype("int32"),
                "neighbour": ids[best.ravel()],
                "d2": np.take_along_axis(d2, best, axis=1).ravel(),
            }))
        return pd.concat(parts)

    return run


def nearest_neighbours(
    df: DataFrame,
    id_col: str,
    features: list[str],
    k: int = 5,
    by: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, rank, neighbour, d2`` with rank 1..k; ties in distance by id; never the row itself.

    With ``by``, neighbours come from the same group; ids are unique over all groups. Groups counted
    to fit one block are searched whole, one task each; larger ones go through the pivots together.
    Both are exact for any data; how much the pivots prune depends on the data.
    """
    keyed = df.select((F.col(by) if by else F.lit(0)).alias("_g"), F.col(id_col).cast("bigint").alias("id"), _as_vector(features).alias("x"))
    rows = write_through(keyed, "knn-rows")  # several passes read them
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n")).collect()  # one row per class
    large = [r["_g"] for r in sizes if r["n"] > block_rows]
    if large:
        schema = T.StructType([T.StructField("_large", rows.schema["_g"].dataType), T.StructField("g", T.IntegerType())])
        numbers = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(large)], schema)
        # A null class is a class like any other.
        rows = rows.join(F.broadcast(numbers), F.col("_g").eqNullSafe(F.col("_large")), "left")
    small = (rows.where("g is null") if large else rows).select("_g", "id", "x")
    out = small.groupBy("_g").applyInPandas(_whole_group(k), "id bigint, rank int, neighbour bigint, d2 double")
    if large:
        # A row without an id is nobody's neighbour and has none.
        found = _pivot_search(rows.where("g is not null and id is not null").select("g", "id", "x"), len(large), len(features), k, block_rows)
        out = out.unionByName(found)
    return out


def _pivot_search(rows: DataFrame, n_groups: int, width: int, k: int, block_rows: int) -> DataFrame:
    spark = rows.sparkSession
    vectors = write_through(_vectors(rows, k), "knn-vectors")
    held = np.zeros(n_groups, dtype="int64")
    for r in vectors.groupBy("g").agg(F.count("*").alias("n")).collect():  # one row per large group
        held[r["g"]] = r["n"]
    wanted = [int(min(max(1, 4 * (n // block_rows)), max(1, MAX_PIVOTS * n // max(1, held.sum())))) for n in held]
    # A bounded number of pivots: the first of each group in a pseudo-random order.
    lot = W.partitionBy("g").orderBy(scatter(F.get("ids", F.lit(0)), 17), F.get("ids", F.lit(0)), "x")
    most = spark.createDataFrame(list(enumerate(wanted)), "g int, _most int")
    picked = (
        vectors.where("tame").select("g", "ids", "x").withColumn("_rn", F.row_number().over(lot)).where(F.col("_rn") <= max(wanted))
        .join(F.broadcast(most), "g").where("_rn <= _most").select("g", "x").orderBy("g", "_rn").toPandas()
    )
    pivots = np.stack(picked["x"].to_numpy()).astype("float64") if len(picked) else np.zeros((0, width))
    cells = _Cells(pivots, np.searchsorted(picked["g"].to_numpy(), np.arange(n_groups + 1)))
    placed = write_through(
        vectors.mapInArrow(_place(cells, width), "g int, x array<double>, ids array<bigint>, cell int, reach double")
        .withColumn("node", F.monotonically_increasing_id()),
        "knn-cells",
    )
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r")).collect():  # ≤ pivots + groups
        cells.size[r["cell"]], cells.radius[r["cell"]] = r["n"], r["r"]
    first, spread = cells.tiles(min(TILE_ROWS, max(block_rows, TILE_VALUES // width)))
    layout = [(c, int(-(-cells.size[c] // block_rows)), int(first[c]), int(spread[c])) for c in np.flatnonzero(cells.size).tolist()]
    cell_table = F.broadcast(spark.createDataFrame(layout, "cell int, n_blocks int, first int, spread int"))
    data = (
        placed.join(cell_table, "cell").withColumn("block", F.pmod(scatter("node", 3), F.col("n_blocks")).cast("int"))
        .withColumn("tile", (F.col("first") + F.pmod(scatter("node", 7), F.col("spread"))).cast("int"))
    )
    visits = write_through(
        data.select("g", "node", "cell", "block", "x").groupBy("cell", "block").applyInArrow(
            _visits(cells, first, spread, width, k), "node bigint, cell int, x array<double>, bound double, tiles array<int>"),
        "knn-visits",
    )
    visitors = [(r["tile"], r["n"]) for r in visits.select(F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count("*").alias("n")).collect()]
    part_rows = min(PART_ROWS, max(2048, sum(n for _, n in visitors) // 64))
    part_table = F.broadcast(spark.createDataFrame([(t, -(-n // part_rows)) for t, n in visitors], "tile int, n_parts int"))
    left = (
        visits.withColumn("tile", F.explode("tiles")).join(part_table, "tile")
        .select("tile", F.pmod(scatter("node", 5), F.col("n_parts")).cast("int").alias("part"), "node", "cell", "x", "bound")
    )
    right = data.join(part_table, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "cell", "ids", "x")
    found = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(
        _tile_search(cells, width, k), "node bigint, near array<struct<d2: double, neighbour: bigint>>"
    )
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    lists = found.groupBy("node").agg(near.alias("near"))
    # Written, so the search runs once; the size of the files then decides about a broadcast below.
    per_vector = write_through(lists.join(placed.select("node", "g", "x"), "node").select("g", "x", "near"), "knn-lists")
    # A vector with very many copies makes one hot key here; adaptive skew handling splits it.
    joined = rows.join(per_vector, ["g", "x"])
    others = F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(others).alias("_p", "_e")).select(
        "id", (F.col("_p") + 1).alias("rank"), F.col("_e.neighbour").alias("neighbour"), F.col("_e.d2").alias("d2")
    )
