"""Pair datasets, statements, paraphrase pairs and result tables on files.

All readers take explicit schemas (never inferred). Question-pair CSVs use a
header, ``,`` separator, ``"`` quotes and ``\\`` escapes; the tokens pandas
reads as missing by default become null here too.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.operators.datasets import split_filter
from nearhit.sources.csvlines import read_csv_split

PAIRS_DDL = "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate string"
# Strings pandas' read_csv treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SPLIT_FILES = {"train": "questions_train.csv", "val": "questions_val.csv", "test": "questions_test.csv",
               "full": "questions.csv"}


def _na(c: str):
    return F.when(F.col(c).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(c))


def _whole(c: str):
    """A whole number, written ``1`` or ``1.0``; anything else is null (cleaning drops it either way)."""
    x = F.expr(f"try_cast({c} AS double)")
    return F.when(x == F.floor(x), F.expr(f"try_cast(try_cast({c} AS double) AS int)"))


def read_pairs(spark: SparkSession, split: str | None = "full", path: str | None = None,
               data_dir: str = "data", splittable: bool = False) -> DataFrame:
    """Question pairs by split (``train``/``val``/``test``/``full``) or an
    explicit path (which wins). An unknown split is an error. ``splittable``
    reads a large file by many tasks (``sources/csvlines.py``); otherwise a file is one task."""
    if path is None:
        if split not in SPLIT_FILES:
            raise ValueError(f"Invalid split: {split}. Choose from {list(SPLIT_FILES)}")
        path = os.path.join(data_dir, SPLIT_FILES[split])
    if splittable:
        df = read_csv_split(spark, path, PAIRS_DDL)
    else:
        df = (spark.read.schema(PAIRS_DDL)
              .option("header", True).option("escape", "\\").option("quote", '"').option("multiLine", True)
              .option("mode", "PERMISSIVE").csv(path))
    return df.select("id", "qid1", "qid2", _na("question1").alias("question1"), _na("question2").alias("question2"),
                     _whole("is_duplicate").alias("is_duplicate"))


def write_splits(df: DataFrame, out_dir: str, fmt: str = "parquet", split_col: str = "split") -> None:
    """One folder per split (``split=train`` ...), so reading a split prunes partitions."""
    w = df.write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        w.option("header", True).option("escape", "\\").csv(out_dir)
    else:
        w.parquet(out_dir)


def read_split(spark: SparkSession, out_dir: str, split: str, fmt: str = "parquet") -> DataFrame:
    r = spark.read.option("header", True).option("escape", "\\") if fmt == "csv" else spark.read
    df = r.csv(out_dir) if fmt == "csv" else r.parquet(out_dir)
    return split_filter(df, split)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """One statement per line, stripped, blank lines dropped."""
    from nearhit.functions.text import strip_ws
    t = spark.read.text(path)
    return t.select(strip_ws("value").alias("statement")).where(F.col("statement") != "")


def write_paraphrases(pairs: DataFrame, path: str) -> None:
    """CSV with header ``statement, semantically_same_statement``."""
    (pairs.select("statement", "semantically_same_statement")
          .write.mode("overwrite").option("header", True).csv(path))


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_results_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Results with an explicit schema; the report takes its configuration
    from the first successful row (``first_success``)."""
    return spark.read.schema(ddl).json(path)


def first_success(results: DataFrame, order: str = "model_key") -> DataFrame:
    return results.where("success").orderBy(order).limit(1)
