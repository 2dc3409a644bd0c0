"""Sweep and metric rules (S12-S17, S21) on small literal fixtures."""

import pytest
from pyspark.sql import functions as F

from nearhit.operators import metrics as M
from nearhit.operators import tune as TU
from nearhit.operators.report import overall_stats
from nearhit.plans.fixtures import REFERENCE_GRID


def scored(spark, rows, model="m"):
    return spark.createDataFrame([(model, i, float(s), int(y)) for i, (s, y) in enumerate(rows)],
                                 "model_key string, pair_id long, similarity double, is_duplicate int")


def test_grid_has_fifty_thresholds():
    assert len(REFERENCE_GRID) == 50 and REFERENCE_GRID[0] == 0.5 and REFERENCE_GRID[-1] == 0.99


def test_sweep_matches_direct_counts(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.random(), rnd.randint(0, 1)) for _ in range(400)]
    sw = {r["threshold"]: r for r in TU.threshold_sweep(scored(spark, rows), REFERENCE_GRID, ["model_key"]).collect()}
    for t in REFERENCE_GRID:
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        assert sw[t]["true_positives"] == tp and sw[t]["false_positives"] == fp


def test_one_class_predictions_rules(spark):
    # every score above the grid: all positive -> precision 0, recall 1, f1 0
    sw = TU.threshold_sweep(scored(spark, [(0.995, 1), (0.999, 0)]), REFERENCE_GRID, ["model_key"]).collect()
    assert all(r["precision"] == 0.0 and r["recall"] == 1.0 and r["f1_score"] == 0.0 for r in sw)
    # every score below: all negative -> precision 1, recall 0
    sw = TU.threshold_sweep(scored(spark, [(0.1, 1), (0.2, 0)]), REFERENCE_GRID, ["model_key"]).collect()
    assert all(r["precision"] == 1.0 and r["recall"] == 0.0 and r["f1_score"] == 0.0 for r in sw)


def test_best_threshold_ties_go_to_lowest(spark):
    df = scored(spark, [(0.55, 1), (0.95, 1), (0.2, 0)])
    best = TU.best_threshold(TU.threshold_sweep(df, REFERENCE_GRID, ["model_key"]), ["model_key"], "f1").first()
    assert best["threshold"] == 0.5 and best["f1_score"] == 1.0


def test_precision_floor_and_all_negative_win(spark):
    df = scored(spark, [(0.6, 0), (0.7, 1), (0.8, 0), (0.3, 1)])
    best = TU.best_threshold(TU.threshold_sweep(df, REFERENCE_GRID, ["model_key"]), ["model_key"], "precision", 0.9).first()
    # first threshold where every prediction is negative has precision 1.0 (S14)
    assert best["threshold"] == 0.81 and best["precision"] == 1.0


def test_unknown_metric_rejected(spark):
    with pytest.raises(ValueError):
        TU.best_threshold(TU.threshold_sweep(scored(spark, [(0.6, 1)]), REFERENCE_GRID), [], "auc")


def test_empty_class_is_error_row(spark):
    res = TU.tune_models(scored(spark, [(0.6, 1), (0.7, 1)]), REFERENCE_GRID).first()
    assert res["success"] is False and res["error"] == TU.EMPTY_CLASS_ERROR


def test_confusion_always_two_by_two(spark):
    cm = M.confusion_matrix(scored(spark, [(0.9, 1), (0.95, 1)]), 0.85).first()
    assert (cm["true_negatives"], cm["false_positives"], cm["false_negatives"], cm["true_positives"]) == (0, 0, 0, 2)


def test_evaluator_zero_rules_and_median(spark):
    ev = M.evaluate_pairs(scored(spark, [(0.1, 0), (0.2, 0), (0.3, 0), (0.9, 0)]), 0.85).first()
    assert ev["precision"] == 0.0 and ev["recall"] == 0.0 and ev["specificity"] == 0.75
    assert ev["sim_median"] == pytest.approx(0.25) and ev["avg_sim_tp"] == 0.0


# Golden: the reference's published 20-model tuning table (config A): precision, recall, F1, threshold.
TABLE_A = [
    (0.8161, 0.3373, 0.4774, 0.92), (0.8092, 0.2827, 0.4190, 0.93), (0.8059, 0.5813, 0.6754, 0.87),
    (0.8077, 0.4760, 0.5990, 0.89), (0.8009, 0.2360, 0.3646, 0.92), (0.8226, 0.2040, 0.3269, 0.92),
    (0.8084, 0.6187, 0.7009, 0.88), (0.8113, 0.5560, 0.6598, 0.97), (0.8267, 0.4960, 0.6200, 0.94),
    (0.8246, 0.4640, 0.5939, 0.91), (0.8080, 0.4600, 0.5862, 0.91), (0.8224, 0.2840, 0.4222, 0.97),
    (0.8203, 0.2800, 0.4175, 0.93), (0.8118, 0.2760, 0.4119, 0.97), (0.8227, 0.2227, 0.3505, 0.97),
    (0.8112, 0.1547, 0.2598, 0.97), (0.8005, 0.3960, 0.5299, 0.93), (0.8106, 0.2853, 0.4221, 0.94),
    (0.8085, 0.2027, 0.3241, 0.95), (0.8090, 0.1920, 0.3103, 0.94),
]


def test_overall_stats_golden(spark):
    flat = spark.createDataFrame(TABLE_A, "precision double, recall double, f1_score double, threshold double")
    s = overall_stats(flat).first()
    assert round(s["mean_f1_score"], 4) == 0.4736 and round(s["std_f1_score"], 4) == 0.1363
    assert round(s["mean_precision"], 4) == 0.8129 and round(s["std_precision"], 4) == 0.0078
    assert round(s["mean_recall"], 4) == 0.3503 and round(s["std_recall"], 4) == 0.1435
    assert round(s["mean_threshold"], 4) == 0.9315 and round(s["std_threshold"], 4) == 0.0303
    assert (s["min_threshold"], s["max_threshold"]) == (0.87, 0.97)
    f1 = flat.select((2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                      - F.col("f1_score")).alias("d")).collect()
    assert max(abs(r["d"]) for r in f1) < 1e-4


def test_grid_bucket_fast_path_matches_comparisons(spark):
    import random
    from nearhit.plans.fixtures import VECTOR_GRID
    rnd = random.Random(11)
    vals = [rnd.uniform(-1.2, 1.2) for _ in range(3000)] + [i / 100.0 for i in range(-60, 110)]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    for grid in (REFERENCE_GRID, VECTOR_GRID):
        fast = TU.grid_bucket(F.col("s"), grid)
        slow = sum((F.col("s") >= F.lit(t)).cast("int") for t in grid)
        assert df.where(fast != slow).count() == 0


def test_all_nan_scores_error_row_and_counts(spark):
    df = spark.createDataFrame([("m", 1, float("nan"), 1), ("m", 2, float("nan"), 0), ("m", 3, None, 1)],
                               "model_key string, pair_id long, similarity double, is_duplicate int")
    r = TU.tune_models(df, REFERENCE_GRID).first()
    assert r["success"] is False and r["error"] == TU.ALL_INVALID_ERROR
    assert (r["tuning_samples"], r["valid_samples"], r["invalid_samples"]) == (3, None, None)
