"""Model comparison at one fixed threshold: one grouped evaluation job for all
models instead of a loop, then rankings over the (small) per-model result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearhit.operators.metrics import evaluate_pairs
from nearhit.operators.tune import with_registry

LEADERS = [("best_f1", "f1_score"), ("most_accurate", "accuracy"),
           ("best_precision", "precision"), ("best_recall", "recall")]


def compare_models(scored: DataFrame, threshold: float, by: str = "model_key") -> DataFrame:
    """Evaluator metrics per model plus registry info and success/error.

    A model with no rows never appears; a model whose scores are all invalid
    is reported with ``success = false``. Wall-clock timing is not part of
    the result (it is not reproducible)."""
    # invalid scores become null inside the one aggregate pass (so a model
    # whose scores are all invalid still gets its row), no separate key scan
    sim = F.col("similarity")
    cleaned = scored.withColumn("similarity", F.when(sim.isNotNull() & ~F.isnan(sim), sim))
    ev = evaluate_pairs(cleaned, threshold, [by], valid_only=True)
    r = with_registry(ev)
    ok = F.col("n_samples") > 0
    metric_cols = [c for c in ev.columns if c not in (by, "n_samples")]
    r = r.select(*[F.when(ok, F.col(c)).alias(c) if c in metric_cols else F.col(c) for c in r.columns])
    return (r.withColumn("n_samples", F.when(ok, F.col("n_samples")))
             .withColumn("success", ok)
             .withColumn("error", F.when(~ok, F.lit("no valid similarity scores"))))


def comparison_ranking(results: DataFrame) -> DataFrame:
    """Successes sorted by F1 rounded to 4 places, descending (ties: registry order)."""
    w = Window.orderBy(F.round("f1_score", 4).desc(), "registry_pos")
    return results.where("success").select(
        F.row_number().over(w).alias("position"), "model_name", "category", "dimension",
        F.round("accuracy", 4).alias("accuracy"), F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"), F.round("f1_score", 4).alias("f1_score"))


def comparison_leaders(results: DataFrame) -> DataFrame:
    """Best F1, most accurate, best precision, best recall; first in registry order on ties."""
    ok = results.where("success")
    u = None
    for award, col in LEADERS:
        part = ok.select(F.lit(award).alias("award"), "model_key", "model_name",
                         F.col(col).alias("value"), "registry_pos")
        u = part if u is None else u.unionByName(part)
    w = Window.partitionBy("award").orderBy(F.col("value").desc(), "registry_pos")
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "registry_pos")


def comparison_flat(results: DataFrame) -> DataFrame:
    """One flat row per successful model (the reference's 15 columns; the two
    timing columns are null because timing is not reproducible)."""
    return results.where("success").select(
        "model_key", "model_name", "category", "dimension", "accuracy", "precision", "recall", "f1_score",
        "specificity", "true_positives", "true_negatives", "false_positives", "false_negatives",
        F.lit(None).cast("double").alias("evaluation_time"), F.lit(None).cast("double").alias("total_time"))
