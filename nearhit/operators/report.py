"""Report tables over tuning results (one row per model, so windows over the
whole result are bounded by the number of models, never by the data).

Ties follow the reference's list order, which is the registry order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearhit.operators.tune import with_registry

FLAT_COLS = ["model_name", "model_key", "category", "dimension", "threshold", "accuracy", "precision",
             "recall", "f1_score", "tn", "fp", "fn", "tp"]


def report_flat(results: DataFrame) -> DataFrame:
    """Successful tuning results as flat rows; missing confusion cells are 0."""
    r = with_registry(results.where("success"))
    return r.select("model_name", "model_key", "category", "dimension",
                    F.col("optimal_threshold").alias("threshold"), "accuracy", "precision", "recall", "f1_score",
                    F.coalesce("true_negatives", F.lit(0)).alias("tn"),
                    F.coalesce("false_positives", F.lit(0)).alias("fp"),
                    F.coalesce("false_negatives", F.lit(0)).alias("fn"),
                    F.coalesce("true_positives", F.lit(0)).alias("tp"), "registry_pos")


def thresholds_by_category(flat: DataFrame) -> DataFrame:
    w = Window.orderBy("category", "threshold", "registry_pos")
    return flat.select(F.row_number().over(w).alias("position"), "category", "model_key", "threshold")


def metrics_by_f1(flat: DataFrame) -> DataFrame:
    w = Window.orderBy(F.col("f1_score").asc(), "registry_pos")
    return flat.select(F.row_number().over(w).alias("position"), "model_key", "precision", "recall", "f1_score")


def top_models(flat: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` by F1; the first in list order wins ties."""
    w = Window.orderBy(F.col("f1_score").desc(), "registry_pos")
    return (flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
                .select("rank", "model_key", "category", "dimension", "threshold", "precision", "recall", "f1_score"))


def top_confusions(flat: DataFrame, n: int = 6) -> DataFrame:
    """The 2x2 matrix of each top-``n`` model as four rows (actual, predicted, count)."""
    top = top_models(flat, n).select("rank", "model_key").join(flat.select("model_key", "tn", "fp", "fn", "tp"),
                                                               "model_key")
    return top.select("rank", "model_key", F.expr(
        "stack(4, 'neg', 'neg', tn, 'neg', 'pos', fp, 'pos', 'neg', fn, 'pos', 'pos', tp) "
        "AS (actual, predicted, count)"))


def category_means(flat: DataFrame) -> DataFrame:
    return flat.groupBy("category").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                        F.avg("f1_score").alias("f1_score"), F.avg("threshold").alias("threshold"))


def overall_stats(flat: DataFrame) -> DataFrame:
    """Mean and sample std of F1, precision, recall, threshold; min/max threshold."""
    aggs = []
    for c in ("f1_score", "precision", "recall", "threshold"):
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    aggs += [F.min("threshold").alias("min_threshold"), F.max("threshold").alias("max_threshold"),
             F.count(F.lit(1)).alias("n_models")]
    return flat.agg(*aggs)


def report_best(flat: DataFrame) -> DataFrame:
    """Rows of best F1, best precision and best recall (first in list order wins)."""
    parts = []
    for name, col in (("best_f1", "f1_score"), ("best_precision", "precision"), ("best_recall", "recall")):
        best = flat.agg(F.max_by(F.struct("model_key", "f1_score", "precision", "recall"),
                                 F.struct(F.col(col), -F.col("registry_pos"))).alias("b"))
        parts.append(best.select(F.lit(name).alias("award"), "b.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_tables(flat: DataFrame) -> DataFrame:
    """Models of each category by F1 descending, with the position inside the category."""
    w = Window.partitionBy("category").orderBy(F.col("f1_score").desc(), "registry_pos")
    return flat.select("category", F.row_number().over(w).alias("position"), "model_key", "dimension",
                       "threshold", "precision", "recall", "f1_score")
