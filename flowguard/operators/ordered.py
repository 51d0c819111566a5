"""Order-dependent statistics that never send an unbounded group to one task.

``running_totals`` is a cumulative sum cut into ranges, ``order_quantiles`` exact quantiles by
narrowing brackets, ``first_in_order`` / ``order_cuts`` exact take-n per stratum by a histogram of
the order key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.session import sized_side, write_through

ONE_TASK_ROWS = 500_000  # rows one task may sort
SKETCH_ACCURACY = 10_000
IN_MEMORY_CELLS = 1_000_000  # values Spark's percentile may keep in one task's memory
#: Size of the quantile sketch and the rank error allowed for, about three times its usual one.
SKETCH_SIZE, SKETCH_ERROR = 4096, 0.004


# --- cumulative sums ------------------------------------------------------------


def range_bounds(df: DataFrame, key: str, one_task_rows: int = ONE_TASK_ROWS) -> list[float]:
    """Cut points that spread the rows of ``df`` evenly over ranges of ``key``.

    Empty if one task can take all rows. The sketch is merged from map-side summaries, so this is
    one narrow scan and no shuffle of rows.
    """
    n = df.select(key).count()
    if n <= one_task_rows:
        return []
    pieces = min(4096, -(-n // one_task_rows) * 4)
    probs = [i / pieces for i in range(1, pieces)]
    row = df.agg(F.percentile_approx(key, probs, max(SKETCH_ACCURACY, 4 * pieces)).alias("b")).first()
    return sorted({float(x) for x in row["b"]})


def with_range(df: DataFrame, key: str, bounds: list[float], name: str = "_range") -> DataFrame:
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    # NaN is the largest value, in a last range of its own, as in Spark's order.
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol=name, handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame,
    key: str,
    measures: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Add ``cum_<m>``: totals of each measure over all rows up to and including this key.

    ``df`` holds one row per key within ``by`` (aggregate first). With ``bounds`` the rows are
    summed per range, the ranges are accumulated (few rows), and each range is accumulated on its
    own task starting from the total of the ranges before it.
    """
    by = by or []
    direction = F.col(key).desc() if descending else F.col(key).asc()
    if not bounds:
        whole = W.partitionBy(*by).orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
        if not by:  # one range, counted to fit one task
            whole = W.partitionBy(F.lit(0)).orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *[F.sum(m).over(whole).alias(f"cum_{m}") for m in measures])
    ranged = with_range(df, key, bounds)
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = (
        W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ).orderBy(range_order).rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    offsets = sums.select(
        *by, "_range", *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    own = W.partitionBy(*by, "_range").orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        _join_alike(ranged, sized_side(offsets), [*by, "_range"])
        .select(
            *df.columns,
            *[(F.sum(m).over(own) + F.col(f"_o_{m}")).alias(f"cum_{m}") for m in measures],
        )
    )


# --- exact quantiles ------------------------------------------------------------


def _position(p: Column, n: Column, rule: str) -> tuple[Column, Column]:
    """0-based lower rank and the fraction towards the next one."""
    if rule == "inclusive":
        pos = p * (n - 1)
        low = F.floor(pos)
        return low, pos - low
    at = p * (n + 1)
    j = F.greatest(F.least(F.floor(at), n - 1), F.lit(1))
    return j - 1, at - j


def _pick(counted: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Interpolated value at ``p`` from rows ``keys, p, n, below, value, cnt``."""
    w = W.partitionBy(*keys, "p").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    low, frac = _position(F.col("p"), F.col("n"), rule)
    ranked = counted.withColumn("_cum", F.sum("cnt").over(w) + F.col("below")).withColumn("_low", low).withColumn("_frac", frac)
    return (
        ranked.groupBy(*keys, "p")
        .agg(
            F.min(F.when(F.col("_cum") > F.col("_low"), F.col("value"))).alias("_a"),
            F.min(F.when(F.col("_cum") > F.col("_low") + 1, F.col("value"))).alias("_b"),
            F.first("_frac").alias("_frac"),
        )
        .select(*keys, "p", F.when((F.col("_frac") == 0) | (F.col("_a") == F.coalesce("_b", "_a")), F.col("_a")).otherwise(
            F.col("_a") * (1 - F.col("_frac")) + F.col("_b") * F.col("_frac")).alias("value"))
    )


class _Groups:
    """A table of one row per group, computed once: on the driver and broadcast if counted to be small, else written."""

    SMALL = 100_000

    def __init__(self, df: DataFrame, purpose: str):
        head = df.limit(self.SMALL + 1).collect()
        self.rows = head if len(head) <= self.SMALL else None
        self.schema = df.schema
        self.df = write_through(df, purpose) if self.rows is None else None
        self.spark = df.sparkSession

    def table(self) -> DataFrame:
        if self.df is None:
            self.df = F.broadcast(self.spark.createDataFrame(self.rows, self.schema))
        return self.df

    def beside(self, data: DataFrame, by: list[str]) -> DataFrame:
        """``data`` with the columns of its group; without groups the one row's values are constants."""
        if by:
            return _join_alike(data, self.table(), by)
        row = self.rows[0]
        text = lambda f: "null" if row[f.name] is None else f"'{row[f.name]!r}'"
        return data.selectExpr("*", *[f"cast({text(f)} as {f.dataType.simpleString()}) as {f.name}" for f in self.schema])

    def most(self, columns: list[str]) -> int:
        if self.rows is not None:
            return max((r[c] or 0 for r in self.rows for c in columns), default=0)
        return self.df.selectExpr(f"max(greatest({', '.join(columns)}, 0)) as most").first()[0] or 0


def _rank(p: float, n: str, rule: str) -> str:
    """0-based lower rank of the quantile among ``n`` values, as SQL; the same as in ``_position``."""
    if rule == "inclusive":
        return f"floor({p!r}D * ({n} - 1))"
    return f"(greatest(least(floor({p!r}D * ({n} + 1)), {n} - 1), 1) - 1)"


def _brackets(data: DataFrame, by: list[str], wanted: list[tuple[int, float]], rule: str, one_task_rows: int) -> _Groups:
    """Per group: values ``n_i`` of column ``_v<i>``, and for the k-th wanted (column, p) an interval ``lo_k .. hi_k``
    that holds the wanted ranks, with the rows below it ``b_k`` and inside ``i_k``.

    All columns are sketched in one aggregate and counted in another. Expressions are SQL text: there may be
    hundreds of columns.
    """
    cols, each = sorted({i for i, _ in wanted}), range(len(wanted))
    inside = lambda k: f"_v{wanted[k][0]} >= lo_{k} and _v{wanted[k][0]} <= hi_{k}"
    # The sketch leaves NaN out; a rank among NaN is found by the open interval.
    sketch = data.groupBy(*by).agg(*[F.expr(x) for i in cols for x in (
        f"count(_v{i}) as n_{i}", f"count_if(_v{i} is not null and not isnan(_v{i})) as m_{i}", f"kll_sketch_agg_double(_v{i}, {SKETCH_SIZE}) as s_{i}")])
    end = lambda k, d: f"if(m_{wanted[k][0]} > 0, kll_sketch_get_quantile_double(s_{wanted[k][0]}, {min(1.0, max(0.0, wanted[k][1] + d))!r}D), null)"
    quoted = [f"`{c}`" for c in by]
    counts = [f"n_{i}" for i in cols]
    groups = _Groups(sketch.selectExpr(*quoted, *counts, *[x for k in each for x in (
        f"{end(k, -SKETCH_ERROR)} as lo_{k}", f"{end(k, SKETCH_ERROR)} as hi_{k}")]), "quantile-sketch")
    last = None
    while True:
        found = groups.beside(data, by).groupBy(*by).agg(*[F.expr(x) for k in each for x in (
            f"count_if(_v{wanted[k][0]} < lo_{k}) as b_{k}", f"count_if({inside(k)}) as i_{k}")])
        parts = []
        for k, (i, p) in enumerate(wanted):
            low = _rank(p, f"n_{i}", rule)
            held = f"b_{k} <= {low} and least({low} + 1, n_{i} - 1) < b_{k} + i_{k}"
            # A sketch that missed its rank gives way to the open interval: exact, only slower.
            parts += [f"if({held}, {yes}, {no}) as {name}_{k}" for name, yes, no in (
                ("lo", f"lo_{k}", "double('-Infinity')"), ("hi", f"hi_{k}", "double('NaN')"), ("b", f"b_{k}", "0"), ("i", f"i_{k}", f"n_{i}"))]
        groups = _Groups(groups.beside(found, by).selectExpr(*quoted, *counts, *parts), "quantile-counts")
        most = groups.most([f"i_{k}" for k in each])
        # Little progress means the rest are copies of few values; the count by value absorbs those.
        if most <= one_task_rows or (last is not None and 2 * most >= last):
            return groups
        last = most
        grid = f"array({', '.join(f'{j / 2000!r}D' for j in range(2001))})"
        finer = groups.beside(data, by).groupBy(*by).agg(*[
            F.expr(f"percentile_approx(if({inside(k)}, _v{wanted[k][0]}, null), {grid}, {SKETCH_ACCURACY}) as q_{k}") for k in each])
        parts = []
        for k, (i, p) in enumerate(wanted):
            step = f"cast(coalesce(floor(try_divide({_rank(p, f'n_{i}', rule)} - b_{k}, i_{k}) * 2000), 0) as int)"
            parts += [f"get(q_{k}, greatest({step} - 2, 0)) as lo_{k}", f"get(q_{k}, least({step} + 3, 2000)) as hi_{k}"]
        groups = _Groups(groups.beside(finer, by).selectExpr(*quoted, *counts, *parts), "quantile-sketch")


def order_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | None = None,
    rule: str = "inclusive",
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Exact quantiles as rows ``by, feature, p, value``; missing values are left out, NaN is the largest value.

    The same rows at every size. A table counted to have few values uses Spark's ``percentile``. Otherwise, for one
    global group as for a hot label, a sketch gives an interval around each wanted rank, a second scan counts what
    lies below and inside it, and only the values inside are moved, as counts per distinct value. Both scans are one
    wide aggregate over all columns; no row is multiplied. ``df`` is read several times, so a costly plan is better
    written first.
    """
    by = by or []
    n_rows = df.count()
    if rule == "inclusive" and n_rows <= one_task_rows and n_rows * len(cols) <= IN_MEMORY_CELLS:
        ps = sorted({float(p) for p in probs})
        listed = f"array({', '.join(f'{p!r}D' for p in ps)})"
        wide = df.groupBy(*by).agg(*[F.expr(f"percentile(cast(`{c}` as double) + 0D, {listed}) as _q{i}") for i, c in enumerate(cols)])
        cells = ", ".join(f"struct({i} as i, {k} as k, get(_q{i}, {k}) as value)" for i in range(len(cols)) for k in range(len(ps)))
        long = wide.selectExpr(*[f"`{c}`" for c in by], f"explode(array({cells})) as _c")
        of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)
        return long.select(*by, of(cols, "_c.i").alias("feature"), of(ps, "_c.k").alias("p"), "_c.value")
    wanted = [(i, p) for i in range(len(cols)) for p in sorted({float(p) for p in probs})]
    data = df.select(*by, *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(cols)])  # no -0
    groups = _brackets(data, by, wanted, rule, one_task_rows)
    quoted = [f"`{c}`" for c in by]
    near = ", ".join(
        f"if(_v{i} >= lo_{k} and _v{i} <= hi_{k}, struct({k} as _k, n_{i} as n, b_{k} as below, _v{i} as value), null)" for k, (i, _) in enumerate(wanted))
    found = groups.beside(data, by).selectExpr(*quoted, f"explode(array_compact(array({near}))) as _f").select(*by, "_f.*")
    counted = found.groupBy(*by, "_k", "n", "below", "value").agg(F.count("*").alias("cnt"))
    place = F.element_at(F.array(*[F.lit(p) for _, p in wanted]), F.col("_k") + 1)
    picked = _pick(counted.withColumn("p", place), [*by, "_k"], rule).select(*by, "_k", "value")
    # A column without values has a null quantile in every group.
    every = groups.table().select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(wanted) - 1))).alias("_k"))
    name = F.element_at(F.array(*[F.lit(cols[i]) for i, _ in wanted]), F.col("_k") + 1)
    return _join_alike(every, picked, [*by, "_k"], "left").select(*by, name.alias("feature"), place.alias("p"), "value")


def medians(df: DataFrame, cols: list[str], one_task_rows: int = ONE_TASK_ROWS) -> dict[str, float | None]:
    """Exact interpolated median of each column over the whole table."""
    rows = order_quantiles(df, cols, [0.5], one_task_rows=one_task_rows).collect()  # one row per column
    return {c: None for c in cols} | {r["feature"]: r["value"] for r in rows}


# --- exact take-n in a pseudo-random order ----------------------------------------


def order_cuts(
    df: DataFrame,
    by: list[str],
    order: Column,
    ties: list[str],
    targets: dict[str, Column],
    bits: int = 16,
) -> DataFrame:
    """For each stratum, the order key of the n-th row for each target ``n``.

    Result: ``by, n_rows, cut_<name>`` with ``cut`` a struct ``(h, ties...)``; null for n = 0. A row
    is among the first n exactly if its own struct is not above the cut.

    A histogram over the top bits of the order key finds the bucket that holds the n-th row; only
    the rows of that bucket are ranked. Nothing is sorted per stratum, so a stratum may hold any
    share of the table. ``targets`` are expressions over ``n_rows``.
    """
    shift = F.lit(1 << (32 - bits))
    keyed = df.select(*by, order.cast("bigint").alias("_h"), *ties).withColumn("_b", F.floor(F.col("_h") / shift))
    strata = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    cells = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    run = strata.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    placed = cells.select(
        *by, "_b", "_c",
        F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("_before"),
        F.sum("_c").over(strata).alias("n_rows"),
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.greatest(F.least(n.cast("bigint"), F.col("n_rows")), F.lit(0)).alias("n"))
        for name, n in targets.items()
    ])
    hit = (
        placed.select(*by, "_b", "_c", "_before", "n_rows", F.explode(wanted).alias("_w"))
        .select(*by, "_b", "n_rows", F.col("_w.name").alias("_name"), (F.col("_w.n") - F.col("_before")).alias("_need"), "_c")
        .where(
            ((F.col("_need") > 0) & (F.col("_need") <= F.col("_c")))
        )
        .drop("_c")
    )
    hit = sized_side(hit)
    near = _join_alike(keyed, hit, [*by, "_b"])
    place = W.partitionBy(*by, "_b", "_name").orderBy("_h", *ties)
    cut = (
        near.withColumn("_rn", F.row_number().over(place))
        .where(F.col("_rn") == F.col("_need"))
        .groupBy(*by)
        .agg(*[
            F.max(F.when(F.col("_name") == name, F.struct(F.col("_h").alias("h"), *ties))).alias(f"cut_{name}")
            for name in targets
        ])
    )
    totals = cells.groupBy(*by).agg(F.sum("_c").alias("n_rows"))
    if not by:
        return totals.withColumn("_one", F.lit(1)).join(cut.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return _join_alike(totals, cut, by, "left")


def _join_alike(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on equal values of ``by``, where a null equals a null; the left columns of ``by`` stay."""
    renamed = right.withColumnsRenamed({c: f"_same_{c}" for c in by})
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in by])
    return left.join(renamed, match, how).drop(*[f"_same_{c}" for c in by])


def first_in_order(
    df: DataFrame,
    by: list[str],
    order: Column,
    ties: list[str],
    n: int | Column,
    bits: int = 16,
) -> DataFrame:
    """Exactly the first ``n`` rows of each stratum in the given order, all columns kept."""
    n = F.lit(n) if isinstance(n, int) else n
    cuts = sized_side(order_cuts(df, by, order, ties, {"n": n}, bits))
    mine = F.struct(order.cast("bigint").alias("h"), *ties)
    if by:
        joined = _join_alike(df, cuts, by)
        return joined.where(mine <= F.col("cut_n")).select(*df.columns)
    cut = cuts.select("cut_n").first()  # one row
    if cut is None or cut["cut_n"] is None:
        return df.limit(0)
    limit = F.struct(*[F.lit(cut["cut_n"][f]).alias(f) for f in cut["cut_n"].asDict()])
    return df.where(mine <= limit)
