"""Column contracts, repair of bad values, deduplication, label filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.constants import BENIGN
from flowguard.functions.labels import is_benign
from flowguard.functions.numbers import as_col, finite_or_null, is_faulty, is_infinite
from flowguard.operators.ordered import ONE_TASK_ROWS, medians
from flowguard.session import write_through


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def normalise_labels(df: DataFrame) -> DataFrame:
    """Bring ``Label``/``Binary`` to lower case; both columns must exist."""
    for want in ("label", "binary"):
        if want not in df.columns and want.title() in df.columns:
            df = df.withColumnRenamed(want.title(), want)
    absent = [c for c in ("label", "binary") if c not in df.columns]
    if absent:
        raise ValueError(f"label columns {absent} not found; the table starts with {df.columns[:20]}")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    """Every column that is not a label column."""
    return [c for c in df.columns if c.lower() not in ("label", "binary")]


def numeric_columns(df: DataFrame, among: list[str] | None = None) -> list[str]:
    among = df.columns if among is None else among
    return [f.name for f in df.schema.fields if f.name in among and isinstance(f.dataType, T.NumericType)]


def split_features(df: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    absent = [c for c in labels if c not in df.columns]
    if absent:
        raise ValueError(f"label columns {absent} not found")
    return df.drop(*labels), df.select(*labels)


def require_columns(df: DataFrame, required: list[str], named: int = 10) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"{len(absent)} required columns absent, first: {absent[:named]}")
    return df


def project(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """The model's columns in the model's order; anything else is dropped."""
    return require_columns(df, features).select(*(keep or []), *features)


def zero_fill_absent(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Opt-in alignment of uploads: columns that are missing altogether become 0.0."""
    have = set(df.columns)
    return df.select(*(keep or []), *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in features])


def nullify_infinite(df: DataFrame, cols: list[str]) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: finite_or_null(c) for c in cols if c in floats})


def impute_median(
    df: DataFrame,
    cols: list[str],
    fit_on: DataFrame | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Fill nulls with the exact column median of ``fit_on`` (default: the table itself)."""
    values = medians(df if fit_on is None else fit_on, cols, one_task_rows)
    return fill_with(df, values)


def fill_with(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in known.items()})


def repair(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Infinite and NaN to null, then null to the median."""
    nulled = nullify_infinite(df, cols)
    base = nulled if fit_on is None else nullify_infinite(fit_on, cols)
    return impute_median(nulled, cols, base)


def drop_copies(df: DataFrame) -> DataFrame:
    """Exact row copies removed; copies meet on the map side, so a hot row costs no skew."""
    return df.dropDuplicates()


def clean_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Copies dropped, then repaired. The distinct rows are written, so the medians do not shuffle whole rows again."""
    return repair(write_through(drop_copies(df), "distinct-rows"), cols)


def with_binary(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("binary", F.when(F.col(label) == BENIGN, 0).otherwise(1))


def row_fault(cols: list[str], id_checks: Column | None = None) -> Column:
    """Name of the first faulty required feature, null for a valid row."""
    reason = F.coalesce(*[F.when(is_faulty(c), F.lit(c)) for c in cols])
    return reason if id_checks is None else F.coalesce(id_checks, reason)


def vector_fault(values: Column | str, length: int) -> Column:
    """Reject reason of an array payload: wrong length, or a null/NaN/infinite entry."""
    values = as_col(values)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | is_infinite(x))
    return F.when(values.isNull() | (F.size(values) != length), F.lit("length")).when(bad, F.lit("value"))


def split_valid(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows fit for scoring, rejected rows with the reason)."""
    marked = df.withColumn("reject_feature", row_fault(cols))
    return (
        marked.where(F.col("reject_feature").isNull()).drop("reject_feature"),
        marked.where(F.col("reject_feature").isNotNull()),
    )


def cast_for_sink(df: DataFrame, features: list[str]) -> DataFrame:
    """Storage types: features FLOAT, binary INT, label STRING."""
    out = df.withColumns({c: F.col(c).cast("float") for c in features})
    if "binary" in df.columns:
        out = out.withColumn("binary", F.col("binary").cast("int"))
    if "label" in df.columns:
        out = out.withColumn("label", F.col("label").cast("string"))
    return out


def attacks_only(df: DataFrame) -> DataFrame:
    """Attack rows; rows marked attack but labelled benign are left out."""
    return df.where((F.col("binary") == 1) & ~is_benign("label"))


def stray_benign(df: DataFrame) -> DataFrame:
    """The rows ``attacks_only`` leaves out although they are marked attack."""
    return df.where((F.col("binary") == 1) & is_benign("label"))


def only_labels(df: DataFrame, label: str, wanted: list[str]) -> DataFrame:
    return df.where(F.col(label).isin(wanted))
