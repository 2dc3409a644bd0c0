"""Result files that are one nested JSON array: an object for each model, with the metrics and confusion cells at
its optimal threshold and the similarity statistics of both classes inside.

They are read as ``VARIANT`` and not with a schema: a failed model has other fields than a
successful one, and fields may come and go. An array has one object a model; many files are many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = {"tuning_samples": "long", "valid_samples": "long", "invalid_samples": "long", "optimization_metric": "string",
          "min_precision_constraint": "double"}
METRICS = ("accuracy", "precision", "recall", "f1_score")
CELLS = ("true_negatives", "false_positives", "false_negatives", "true_positives")
CLASSES = {"duplicates": "dup", "non_duplicates": "nondup"}
STATISTICS = ("mean", "std", "min", "max")


def nested_result() -> Column:
    """One row of ``tune_models`` as the nested struct. A failed model (``success`` false or null) has its key, ``success``
    and ``error`` only, a successful one all but ``error``."""
    good = F.coalesce(F.col("success"), F.lit(False))
    metrics = F.struct(*METRICS, F.struct(*CELLS).alias("confusion_matrix"))
    stats = F.struct(*[F.struct(*[F.col(f"{short}_{s}").alias(s) for s in STATISTICS]).alias(c) for c, short in CLASSES.items()])
    fields = {"optimal_threshold": F.col("optimal_threshold"), "metrics_at_optimal": metrics, "similarity_stats": stats,
              **{c: F.col(c) for c in CONFIG}}
    return F.struct("model_key", good.alias("success"), F.when(~good, F.col("error")).alias("error"),
                    *[F.when(good, c).alias(n) for n, c in fields.items()])


def write_nested_results(results: DataFrame, path: str, order: str = "model_key") -> None:
    """Rows of ``tune_models`` as one JSON array in ``order``, written under the folder ``path``.

    The array is one value: it is bounded by the number of models, not by the data. No rows give an empty array."""
    items = results.select(F.struct(F.col(order), F.to_json(nested_result()).alias("json")).alias("item"))
    ordered = F.transform(F.array_sort(F.collect_list("item")), lambda x: x["json"])
    text = F.concat(F.lit("["), F.array_join(ordered, ",\n"), F.lit("]"))
    items.agg(text.alias("value")).write.mode("overwrite").text(path)


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, result): the objects of the arrays in all files of ``path``, each as a VARIANT.

    ``place`` counts from 0 within an array. A file that holds no JSON array gives no rows."""
    files = spark.read.text(path, wholetext=True)
    parsed = files.select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("array"))
    found = parsed.lateralJoin(spark.tvf.variant_explode(F.col("array").outer()))
    return found.where("key IS NULL").select("file", F.col("pos").cast("long").alias("place"), F.col("value").alias("result"))


def flat_results(results: DataFrame) -> DataFrame:
    """One flat row for each of ``read_nested_results``; a field that is absent or of another kind is null, an absent
    ``success`` false."""
    def at(path: str, kind: str, name: str) -> Column:
        return F.try_variant_get("result", f"$.{path}", kind).alias(name)

    success = F.coalesce(F.try_variant_get("result", "$.success", "boolean"), F.lit(False)).alias("success")
    return results.select(
        "file", "place", at("model_key", "string", "model_key"), success, at("error", "string", "error"),
        at("optimal_threshold", "double", "optimal_threshold"), *[at(c, kind, c) for c, kind in CONFIG.items()],
        *[at(f"metrics_at_optimal.{m}", "double", m) for m in METRICS],
        *[at(f"metrics_at_optimal.confusion_matrix.{c}", "long", c) for c in CELLS],
        *[at(f"similarity_stats.{c}.{s}", "double", f"{short}_{s}") for c, short in CLASSES.items() for s in STATISTICS])


def first_successful(flat: DataFrame) -> DataFrame:
    """The first successful result of each file in array order, where a report takes its configuration from."""
    row = F.struct(*[c for c in flat.columns if c != "file"])
    return flat.where("success").groupBy("file").agg(F.min_by(row, "place").alias("row")).select("file", "row.*")
