"""Label joins: known and unseen classes, index decoding, row alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import sized_side


def known_classes(df: DataFrame, label: str, seen: DataFrame) -> DataFrame:
    """Rows whose label occurs in ``seen`` (a label column of the training rows)."""
    return df.join(sized_side(seen.select(label).distinct()), label, "left_semi")


def unseen_classes(df: DataFrame, label: str, seen: DataFrame) -> DataFrame:
    """Label and row count of rows whose label never occurs in ``seen``."""
    rest = df.join(sized_side(seen.select(label).distinct()), label, "left_anti")
    return rest.groupBy(label).agg(F.count("*").alias("n_rows"))


def encode_labels(train: DataFrame, label: str) -> DataFrame:
    """``(label, class_index)``: distinct training labels in name order, from 0.

    The number of classes is small by nature; ranks come from a window over the distinct names.
    """
    from pyspark.sql import Window as W

    names = train.select(label).where(F.col(label).isNotNull()).distinct()
    return names.select(label, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(label)) - 1).alias("class_index"))


def with_class_index(df: DataFrame, label: str, encoding: DataFrame) -> DataFrame:
    return df.join(sized_side(encoding), label, "left")


def decode_index(df: DataFrame, index: str, encoding: DataFrame, label: str, name: str) -> DataFrame:
    """Class name of a predicted index."""
    names = encoding.select(F.col("class_index").alias(index), F.col(label).alias(name))
    return df.join(sized_side(names), index, "left")


def align(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features and labels kept in different tables, joined on the row id."""
    return features.join(labels, key)
