"""Label text: normal forms, safe file names, risk tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowguard.constants import BENIGN
from flowguard.functions.numbers import as_col

EN_DASH = "–"


def lookup_key(label: Column | str) -> Column:
    """Trimmed lower-case form with a plain hyphen, so both spellings of a class meet."""
    return F.replace(F.lower(F.trim(as_col(label))), F.lit(EN_DASH), F.lit("-"))


def is_benign(label: Column | str) -> Column:
    return F.upper(F.trim(as_col(label))) == BENIGN


def safe_name(label: Column | str) -> Column:
    """Form used in file and partition names."""
    return F.replace(F.replace(as_col(label), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def scenario_risk(label: Column | str) -> Column:
    label = as_col(label)
    return F.when(label == BENIGN, F.lit("low")).when(label == "Infiltration", F.lit("medium")).otherwise(F.lit("high"))
