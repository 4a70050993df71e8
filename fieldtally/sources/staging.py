"""Intermediate tables in the cluster's shared folder.

Loops, and methods that use one aggregated table in many places, write it once.
The result survives the loss of executors, cuts the plan, and has real size
statistics, so Spark can choose joins by size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, a folder
    beside the session's tables, which its executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/staging").rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldtally-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
