"""Stratified splits, balanced sub-samples and seeded picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.constants import SPLIT_DEFAULTS, TREE_SAMPLE_ROWS
from flowguard.functions.numbers import scatter
from flowguard.operators.ordered import first_in_order, order_cuts
from flowguard.session import sized_side


def stratified_split(
    df: DataFrame,
    strata: list[str],
    id_cols: list[str],
    order: Column | None = None,
    test: float = SPLIT_DEFAULTS["test_size"],
    val: float = SPLIT_DEFAULTS["val_size"],
    seed: int = SPLIT_DEFAULTS["random_state"],
    bits: int = 16,
) -> DataFrame:
    """Add ``split``: exactly round(n·test) rows of each stratum are test, the next round(n·val) val.

    Both fractions are shares of the whole table. The order within a stratum is a seeded scatter of
    the id. Strata may be of any size: only histogram buckets at the two borders are ranked.
    """
    order = scatter(id_cols[0], seed) if order is None else order
    n = F.col("n_rows")
    n_test, n_val = F.round(n * test), F.round(n * val)
    targets = {"test": n_test, "val": n_test + n_val}
    cuts = sized_side(order_cuts(df, strata, order, id_cols, targets, bits)).drop("n_rows")
    mine = F.struct(order.cast("bigint").alias("h"), *id_cols)
    split = (
        F.when(mine <= F.col("cut_test"), F.lit("test"))
        .when(mine <= F.col("cut_val"), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    # Left join: a row without a stratum stays, as training data.
    return df.join(cuts, strata, "left").select(*df.columns, split.alias("split"))


def hashed_split(
    df: DataFrame, id_col: str, test: float = 0.15, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Split by id threshold: no shuffle, sizes exact only in expectation."""
    u = scatter(id_col, seed) / F.lit(4294967296.0)
    split = F.when(u < test, F.lit("test")).when(u < test + val, F.lit("val")).otherwise(F.lit("train"))
    return df.withColumn("split", split)


def source_split(df: DataFrame, source: str, test_sources: list) -> DataFrame:
    """Leakage-safe split: whole files or capture days go to one side."""
    return df.withColumn("split", F.when(F.col(source).isin(test_sources), F.lit("test")).otherwise(F.lit("train")))


def balanced_sample(
    df: DataFrame,
    label: str,
    id_col: str,
    per_class: int = TREE_SAMPLE_ROWS // 2,
    when_above: int = TREE_SAMPLE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """At most ``per_class`` rows of each class once the table exceeds ``when_above`` rows."""
    if df.count() <= when_above:
        return df
    return first_in_order(df, [label], scatter(id_col, seed), [id_col], per_class)


def row_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), reproducible, without a global sort.

    Rows that share an id, null ids too, are told apart by a hash of the whole row; of equal rows any are taken.
    """
    order = F.coalesce(scatter(id_col, seed), F.lit(0)).cast("bigint")
    tagged = df.withColumn("_row", F.xxhash64(*df.columns))
    found = order_cuts(tagged, [], order, [id_col, "_row"], {"n": F.lit(n)}).select("cut_n").first()  # one row
    if found is None or found["cut_n"] is None:
        return df.limit(0)
    cut = found["cut_n"].asDict()
    last = F.struct(*[F.lit(v).cast(t).alias(f) for (f, v), t in zip(cut.items(), ("bigint", df.schema[id_col].dataType, "bigint"))])
    mine = F.struct(order.alias("h"), id_col, "_row")
    before = tagged.where(mine < last)
    return before.unionByName(tagged.where(mine.eqNullSafe(last)).limit(max(n - before.count(), 0))).drop("_row")


def one_per_group(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """First row of each group; the group limit runs before the shuffle."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def pick_or_first(df: DataFrame, label: str, wanted: list[str], order: list[Column | str]) -> DataFrame:
    """First row with a wanted label; if there is none, the first row of the table.

    One top-1 over (wanted first, order): per-partition heads only reach the last task.
    """
    preferred = F.when(F.col(label).isin(wanted), 0).otherwise(1)
    return df.orderBy(preferred, *order).limit(1)


def capped_union(df: DataFrame, label: str, order: Column, ties: list[str], caps: dict[str, int]) -> DataFrame:
    """UNION ALL of per-class samples of given sizes, as one pass with a size per class."""
    cap = F.lit(None).cast("bigint")
    for name, n in caps.items():
        cap = F.when(F.col(label) == name, F.lit(n)).otherwise(cap)
    return first_in_order(df.where(F.col(label).isin(list(caps))), [label], order, ties, cap)
