"""Small numeric column helpers with the NaN behaviour the scoring rules rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_infinite(c: Column | str) -> Column:
    return F.abs(as_col(c)) == F.lit(INF)


def is_faulty(c: Column | str) -> Column:
    """Null, NaN or infinite."""
    c = as_col(c)
    return c.isNull() | F.isnan(c) | is_infinite(c)


def finite_or_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(F.isnan(c) | is_infinite(c), F.lit(None)).otherwise(c)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; null and NaN stay (``least``/``greatest`` alone would hide them)."""
    c = as_col(c)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def sum_of(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def scatter(id_col: Column | str, seed: int = 0) -> Column:
    """Pseudo-random order key in [0, 2^32) from an integer id.

    Plain arithmetic, so the order is the same in any SQL engine and on any re-run of a task.
    """
    # The id is folded to 31 bits first so the product stays inside BIGINT; ties go to the id.
    folded = F.pmod(as_col(id_col).cast("bigint"), F.lit(2147483648))
    return F.pmod(folded * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))
