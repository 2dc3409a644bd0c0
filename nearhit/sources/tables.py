"""Read the input parquet tables (column pruning and filters reach the scan)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from nearhit.session import exists

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet`` as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, empty where its folder does not exist yet. Any other failure to read stays an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
