"""Session defaults, the shared working folder and size-checked small tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(app: str = "flowguard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for ``purpose`` under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder of this machine; executors elsewhere could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="flowguard-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def write_through(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a later pass would otherwise repeat a costly plan; it survives executor loss.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Make a join side that is broadcast only if it was counted to be small.

    Up to ``max_rows`` rows the side becomes a local table with a broadcast hint; beyond that the
    side is returned as it is, and the join is shuffled with adaptive skew handling.
    """
    head = df.limit(max_rows + 1).collect()
    if len(head) > max_rows:
        return df
    # All fields nullable: a null struct may have fields that were never null in the input.
    schema = T.StructType.fromJson(json.loads(df.schema.json().replace('"nullable":false', '"nullable":true')))
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=schema))
