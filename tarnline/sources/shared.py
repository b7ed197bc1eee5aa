"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new name under the folder that all executors share (spark.checkpoint.dir).

    Where that is unset, a temporary folder serves a session whose executors are threads of the driver; any other session fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tarnline.shared.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnline-")
        spark.conf.set("spark.tarnline.shared.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def sunk(df: DataFrame, kind: str = "parquet", by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """df written to the shared folder in a format that Spark knows, in a folder for each value of `by`, and read again with df's schema.

    Reads push filters on `by` down to the folders, and on other columns as far as the format lets them.
    """
    path = shared_dir(df.sparkSession)
    df.write.format(kind).partitionBy(*by).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)
