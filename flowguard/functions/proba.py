"""Expressions over a class-probability map (``MAP<STRING, DOUBLE>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.functions.numbers import as_col


def ranked(m: Column | str) -> Column:
    """Entries by falling value; equal values by name."""
    pairs = F.transform(
        F.map_entries(as_col(m)), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("name"))
    )
    return F.transform(
        F.array_sort(pairs), lambda e: F.struct(e["name"].alias("name"), (-e["neg"]).alias("value"))
    )


def top_margin(m: Column | str) -> Column:
    """Best minus second-best value; the best value itself if there is only one class."""
    values = F.sort_array(F.map_values(as_col(m)), asc=False)
    return F.when(F.size(values) > 1, F.get(values, F.lit(0)) - F.get(values, F.lit(1))).otherwise(
        F.get(values, F.lit(0))
    )


def best_class(m: Column | str) -> Column:
    return F.get(ranked(m), F.lit(0))["name"]


def best_value(m: Column | str) -> Column:
    return F.array_max(F.map_values(as_col(m)))


def rounded(m: Column | str, digits: int = 6) -> Column:
    return F.transform_values(as_col(m), lambda _, v: F.round(v, digits))


def value_of(m: Column | str, name: Column | str) -> Column:
    """Probability of a class, 0.0 when the map does not list it."""
    return F.coalesce(F.try_element_at(as_col(m), as_col(name)), F.lit(0.0))


def spectrum(m: Column | str, above: float = 0.001, limit: int = 8) -> Column:
    """The visible classes: value above the cut, limited to [0, 1], best first."""
    seen = F.filter(ranked(m), lambda e: e["value"] > F.lit(above))
    shown = F.transform(
        seen,
        lambda e: F.struct(
            e["name"].alias("name"), F.greatest(F.least(e["value"], F.lit(1.0)), F.lit(0.0)).alias("value")
        ),
    )
    return F.slice(shown, 1, limit)


def key_signals(m: Column | str, limit: int = 5) -> Column:
    """The features of largest magnitude, signed values kept."""
    pairs = F.transform(
        F.map_entries(as_col(m)),
        lambda e: F.struct((-F.abs(e["value"])).alias("neg"), e["key"].alias("name"), e["value"].alias("value")),
    )
    best = F.slice(F.array_sort(pairs), 1, limit)
    return F.transform(best, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def all_zero(values: Column | str, eps: float = 1e-9) -> Column:
    """Every value of an array is zero within ``eps``."""
    return F.forall(as_col(values), lambda x: F.abs(x) < F.lit(eps))
