"""File sources and sinks: day CSVs, split tables, decision tables, logs, scenario documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard.constants import FEEDBACK_RATE, TEST_DAY_FILES, TRAIN_DAY_FILES
from flowguard.functions.labels import safe_name
from flowguard.functions.numbers import scatter
from flowguard.operators.clean import clean_table, feature_columns, normalise_labels, numeric_columns, strip_headers
from flowguard.operators.clean import with_binary, zero_fill_absent
from flowguard.operators.split import source_split

SPLITS = ("train", "val", "test")


# --- CSV ------------------------------------------------------------------------


def read_day_files(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Union of day files with one schema; a file listed twice is read once, a missing one is an error."""
    paths = list(dict.fromkeys(paths))
    reader = spark.read.option("header", True)
    if schema is not None:
        # Raw headers carry blanks; names come from the schema, matched by position.
        reader = reader.schema(schema).option("enforceSchema", True)
    else:
        reader = reader.option("inferSchema", True)
    return strip_headers(reader.csv(paths)) if paths else spark.createDataFrame([], schema or T.StructType([]))


def read_mixed_days(spark: SparkSession, days: dict[str, T.StructType]) -> DataFrame:
    """Union by name of day files whose columns differ; absent columns become null."""
    out = None
    for path, schema in days.items():
        part = read_day_files(spark, [path], schema)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files given")
    return out


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def day_pools(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows of the train and test capture days, with ``split``; other files are left out."""
    known = df.where(F.col(source).isin([*TRAIN_DAY_FILES, *TEST_DAY_FILES]))
    return source_split(known, source, TEST_DAY_FILES)


def build_clean_table(raw: DataFrame) -> DataFrame:
    """Training table from raw rows: trimmed headers, no copies, repaired numbers, binary label."""
    df = strip_headers(raw)
    if "Label" in df.columns:
        df = df.withColumnRenamed("Label", "label")
    df = with_binary(df) if "binary" not in df.columns and "Binary" not in df.columns else df
    df = normalise_labels(df)
    numeric = numeric_columns(df, feature_columns(df))
    return clean_table(df, numeric)


def read_batch_csv(spark: SparkSession, path: str, schema: T.StructType, features: list[str]) -> DataFrame:
    """Uploaded batch aligned to the model's columns; a file without rows is an error."""
    df = strip_headers(spark.read.option("header", True).schema(schema).csv(path))
    if df.isEmpty():
        raise ValueError("the uploaded file has no rows")
    return zero_fill_absent(df, features, keep=[c for c in df.columns if c not in features])


def write_decisions_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").option("header", True).csv(path)


# --- split tables -----------------------------------------------------------------


def write_splits(df: DataFrame, path: str) -> None:
    """One table, one folder per split; features and labels stay in their row.

    The write is partitioned by value only: no shuffle, files as large as the input partitions.
    """
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


# --- JSON logs and documents ----------------------------------------------------------


def feedback_rows(decisions: DataFrame, id_col: str, features: list[str] | None = None, rate: float = FEEDBACK_RATE) -> DataFrame:
    """Rows worth logging (served risk HIGH or predicted attack), a fixed share of them by id."""
    picked = decisions.where((F.col("trust.risk_level") == "HIGH") | (F.col("binary_pred") == 1))
    share = F.lit(int(round(rate * 4294967296)))
    picked = picked.where(scatter(id_col) < share)
    cells = [F.array(*[F.col(f).cast("float") for f in features]).alias("features")] if features else []
    return picked.select(id_col, "prediction", "attack_type", "trust", *cells)


def append_feedback(rows: DataFrame, path: str) -> None:
    stamped = rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    stamped.write.mode("append").json(path)


def write_scenarios(scenarios: DataFrame, path: str, label: str = "label") -> None:
    """One folder per class, named by its safe form."""
    named = scenarios.withColumn("safe_label", safe_name(label))
    named.write.mode("overwrite").partitionBy("safe_label").json(path)


SCENARIO_SCHEMA = (
    "label string, validated boolean, source_index bigint, distance double, "
    "expected struct<attack_type:string,action:string>, features map<string,double>"
)


def read_scenarios(spark: SparkSession, glob: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable documents, skipped ones): corrupt text, no validation or missing features skip."""
    schema = T.StructType.fromDDL(SCENARIO_SCHEMA + ", _corrupt string")
    docs = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .json(glob)
    )
    keys = F.array(*[F.lit(r) for r in required])
    usable = F.coalesce(
        F.col("_corrupt").isNull() & F.col("validated")
        & (F.size(F.array_except(keys, F.map_keys("features"))) == 0),
        F.lit(False),
    )
    marked = docs.withColumn("_ok", usable)
    return marked.where("_ok").drop("_ok", "_corrupt"), marked.where("NOT _ok").drop("_ok")


# --- run results ------------------------------------------------------------------------


def append_results(metrics: DataFrame, path: str) -> None:
    """Long-form results ``run, split, class, metric, value`` as JSON lines."""
    metrics.select("run", "split", "class", "metric", "value").write.mode("append").json(path)
