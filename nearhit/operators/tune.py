"""Threshold tuning: single-pass sweep, constrained argmax, per-model results.

The reference evaluates 50 thresholds with 50 passes over the scores. Here
each score row gets ``bucket = #{grid thresholds <= similarity}`` (codegen'd
comparisons), one aggregate counts positives/negatives per
``(group, bucket)`` with map-side combine, and a reverse cumulative sum over
at most ``len(grid)+1`` rows per group gives the confusion cells at every
threshold: a threshold ``t_j`` (0-based) predicts positive exactly for rows
with ``bucket >= j + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearhit.operators.metrics import _moments, metric_columns, moment_columns
from nearhit.operators.registry import registry

METRICS = ("f1", "accuracy", "precision", "recall")
METRIC_COL = {"f1": "f1_score", "accuracy": "accuracy", "precision": "precision", "recall": "recall"}


def valid_scores(scored: DataFrame, sim: str = "similarity") -> DataFrame:
    """Drop null/NaN similarities (the reference drops NaN)."""
    return scored.where(F.col(sim).isNotNull() & ~F.isnan(sim))


def score_validity(scored: DataFrame, by: list[str], sim: str = "similarity") -> DataFrame:
    """valid / invalid counts per group, with the reference's warning flag (< 100)."""
    bad = F.col(sim).isNull() | F.isnan(sim)
    return (scored.groupBy(*by).agg(F.count(F.lit(1)).alias("tuning_samples"),
                                    F.count_if(~bad).alias("valid_samples"),
                                    F.count_if(bad).alias("invalid_samples"))
                  .withColumn("few_valid", F.col("valid_samples") < 100))


def _uniform(ts: list[float], den: int = 100):
    """(lo, hi) when the grid is exactly ``i / den`` for consecutive integers."""
    ints = [round(t * den) for t in ts]
    if ints != list(range(ints[0], ints[0] + len(ints))):
        return None
    if any(i / den != t for i, t in zip(ints, ts)):
        return None
    return ints[0], ints[-1]


def grid_bucket(s, ts: list[float]):
    """Number of grid thresholds ``<= s`` (same double comparisons as the grid).

    For a grid ``i/100`` (both grids in use) this is ``floor(s*100)`` fixed up
    by one step either way, a handful of operations per row; any other grid
    falls back to one comparison per threshold."""
    u = _uniform(ts)
    if u is None:
        return sum((s >= F.lit(t)).cast("int") for t in ts)
    lo, hi = u
    k = F.floor(s * 100)
    m = (F.when((k + 1) / F.lit(100.0) <= s, k + 1).when(k / F.lit(100.0) > s, k - 1).otherwise(k))
    return F.least(F.greatest(m - lo + 1, F.lit(0)), F.lit(hi - lo + 1)).cast("int")


def _sweep(scored: DataFrame, ts: list[float], by: list[str], sim: str, label: str, rules: str,
           parts: dict | None = None) -> DataFrame:
    """Every grid threshold of every group, from one aggregate over (group, bucket).

    ``parts`` (name -> (how they add up, aggregate)) are added up over the
    group's buckets, the one of invalid scores (bucket null) included, and carried along."""
    ok = F.col(sim).isNotNull() & ~F.isnan(sim)
    counts = (scored.groupBy(*by, F.when(ok, grid_bucket(F.col(sim), ts)).alias("_b"))
               .agg(F.count_if(ok & (F.col(label) == 1)).alias("_pos"), F.count_if(ok & (F.col(label) == 0)).alias("_neg"),
                    *[c.alias(n) for n, (_, c) in (parts or {}).items()]))
    # one histogram per group (at most len(grid)+2 entries), so the input is
    # scanned once; thresholds are then read off the histogram
    per = counts.groupBy(*by).agg(F.collect_list(F.struct("_b", "_pos", "_neg")).alias("_h"),
                                  F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"),
                                  *[getattr(F, how)(n).alias(n) for n, (how, _) in (parts or {}).items()])
    full = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(ts)))).alias("_b"))
    above = F.filter("_h", lambda x: x["_b"] >= F.col("_b"))
    full = (full.withColumn("tp", F.aggregate(above, F.lit(0).cast("long"), lambda a, x: a + x["_pos"]))
                .withColumn("fp", F.aggregate(above, F.lit(0).cast("long"), lambda a, x: a + x["_neg"])))
    grid_arr = F.array(*[F.lit(t) for t in ts])
    out = full.select(*by, F.element_at(grid_arr, F.col("_b").cast("int")).alias("threshold"),
                      F.col("tp").cast("bigint").alias("true_positives"),
                      F.col("fp").cast("bigint").alias("false_positives"),
                      (F.col("_N") - F.col("fp")).cast("bigint").alias("true_negatives"),
                      (F.col("_P") - F.col("tp")).cast("bigint").alias("false_negatives"),
                      (F.col("_P") + F.col("_N")).cast("bigint").alias("total"), *(parts or {}))
    return out.select("*", *metric_columns("true_positives", "false_positives", "true_negatives",
                                           "false_negatives", rules))


def threshold_sweep(scored: DataFrame, grid: list[float], by: list[str] | None = None,
                    sim: str = "similarity", label: str = "is_duplicate", rules: str = "tuner") -> DataFrame:
    """Confusion cells and metrics at every grid threshold, per group."""
    return _sweep(valid_scores(scored, sim), sorted(float(t) for t in grid), list(by or []), sim, label, rules)


def best_threshold(sweep: DataFrame, by: list[str] | None = None, metric: str = "f1",
                   min_precision: float | None = None) -> DataFrame:
    """Row of the best threshold per group: highest score, lowest threshold on
    ties (strict ``>`` in a forward scan). Groups with no admissible
    threshold are absent (``tune_models`` turns them into error rows)."""
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    by = list(by or [])
    cand = sweep if min_precision is None else sweep.where(F.col("precision") >= F.lit(float(min_precision)))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(
        F.col(METRIC_COL[metric]).desc(), F.col("threshold").asc())
    return cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def no_threshold_error(min_precision: float | None) -> str:
    if min_precision is not None:
        return f"every threshold has a precision below {min_precision:.2f}"
    return "the grid has no threshold"


EMPTY_CLASS_ERROR = "A class has no valid samples"
ALL_INVALID_ERROR = "no pair has a valid score"


def tune_models(scored: DataFrame, grid: list[float], metric: str = "f1",
                min_precision: float | None = None, by: list[str] | None = None,
                sim: str = "similarity", label: str = "is_duplicate") -> DataFrame:
    """One result row per model (flattened T10): optimal threshold, metrics and
    confusion cells there, sample counts, per-class similarity stats,
    ``success`` and ``error``. A failing model yields an error row (S22, S23)."""
    if metric not in METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    by = list(by or ["model_key"])
    s = F.col(sim)
    ok = s.isNotNull() & ~F.isnan(s)
    d, nd = ok & (F.col(label) == 1), ok & (F.col(label) == 0)
    parts = {"tuning_samples": ("sum", F.count(F.lit(1))), "valid_samples": ("sum", F.count_if(ok)),
             "invalid_samples": ("sum", F.count_if(~ok))} | _moments("_d", s, d) | _moments("_n", s, nd)
    sweep = _sweep(scored, sorted(float(t) for t in grid), by, sim, label, "tuner", parts)
    # the best admissible threshold; a group without one keeps a row of its own, with no threshold
    admitted = (F.col("valid_samples") > 0) if min_precision is None else \
        (F.col("valid_samples") > 0) & (F.col("precision") >= F.lit(float(min_precision)))
    w = Window.partitionBy(*by).orderBy(F.col("_ok").desc(), F.col(METRIC_COL[metric]).desc(), F.col("threshold").asc())
    r = (sweep.withColumn("_ok", admitted).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
              .withColumn("optimal_threshold", F.when(F.col("_ok"), F.col("threshold"))))
    r = r.select("*", *moment_columns("_d", "dup"), *moment_columns("_n", "nondup"),
                 F.col("_d_n").alias("_nd"), F.col("_n_n").alias("_nn"))
    err = (F.when(F.col("valid_samples") == 0, F.lit(ALL_INVALID_ERROR))
            .when(F.col("optimal_threshold").isNull(), F.lit(no_threshold_error(min_precision)))
            .when((F.col("_nd") == 0) | (F.col("_nn") == 0), F.lit(EMPTY_CLASS_ERROR)))
    r = r.withColumn("error", err).withColumn("success", F.col("error").isNull())
    keep_when_ok = ["optimal_threshold", "accuracy", "precision", "recall", "f1_score", "true_negatives",
                    "false_positives", "false_negatives", "true_positives", "total",
                    "dup_mean", "dup_std", "dup_min", "dup_max",
                    "nondup_mean", "nondup_std", "nondup_min", "nondup_max",
                    "valid_samples", "invalid_samples"]
    cols = [*by, "tuning_samples"]
    cols += [F.when(F.col("success"), F.col(c)).alias(c) for c in keep_when_ok]
    cols += [F.lit(metric).alias("optimization_metric"),
             F.lit(None if min_precision is None else float(min_precision)).cast("double").alias("min_precision_constraint"),
             "success", "error"]
    return r.select(*cols)


def with_registry(results: DataFrame) -> DataFrame:
    reg = registry(results.sparkSession).select("model_key", "model_name", "dimension", "category",
                                                "registry_pos", "category_rank")
    return results.join(F.broadcast(reg), "model_key", "left")


def optimal_thresholds(results: DataFrame) -> DataFrame:
    """model_key -> optimal threshold, successes only."""
    return results.where("success").select("model_key", "optimal_threshold")


def tuning_ranking(results: DataFrame) -> DataFrame:
    """Successes by F1 rounded to 4 places (desc); position and best flag.
    Position ties go to registry order; "best" uses the unrounded F1, first
    in registry order wins."""
    r = with_registry(results.where("success"))
    w = Window.orderBy(F.round("f1_score", 4).desc(), F.col("registry_pos"))
    wb = Window.orderBy(F.col("f1_score").desc(), F.col("registry_pos"))
    # the ranking is over models (one row each), never over raw pairs
    return (r.withColumn("position", F.row_number().over(w))
             .withColumn("is_best", F.row_number().over(wb) == 1)
             .select("position", "model_key", "model_name", "category", "optimal_threshold",
                     "accuracy", "precision", "recall", "f1_score", "is_best"))


STRATEGIES = [("f1", "f1", None), ("precision", "precision", None), ("recall", "recall", None),
              ("f1_constrained", "f1", "MINP")]


def strategy_comparison(scored: DataFrame, grid: list[float], min_precision: float,
                        by: list[str] | None = None) -> DataFrame:
    """F1-, precision-, recall- and constrained-F1-optimal thresholds side by
    side per model, from one sweep."""
    by = list(by or ["model_key"])
    sweep = threshold_sweep(scored, grid, by)
    cols = []
    for name, metric, constrained in STRATEGIES:
        ok = F.col("precision") >= F.lit(float(min_precision)) if constrained else F.lit(True)
        order = F.when(ok, F.struct(F.col(METRIC_COL[metric]), -F.col("threshold")))  # highest score, then lowest threshold
        cols += [F.max_by("threshold", order).alias(f"{name}_threshold"), F.max_by("f1_score", order).alias(f"{name}_f1")]
    return sweep.groupBy(*by).agg(*cols)


def tune_then_validate(train: DataFrame, evals: DataFrame, grid: list[float], metric: str = "f1",
                       min_precision: float | None = None, split_col: str = "split") -> DataFrame:
    """Tune on ``train``, then textbook metrics at the tuned threshold on each
    split of ``evals``. The tuned table has one row per model."""
    res = tune_models(train, grid, metric, min_precision).where("success").select(
        "model_key", F.col("optimal_threshold").alias("tuned_threshold"))
    j = evals.join(res, "model_key")
    p = (F.col("similarity") >= F.col("tuned_threshold")).cast("int")
    t = F.col("is_duplicate")
    cm = j.groupBy("model_key", split_col, "tuned_threshold").agg(
        F.count_if((p == 1) & (t == 1)).alias("true_positives"),
        F.count_if((p == 1) & (t == 0)).alias("false_positives"),
        F.count_if((p == 0) & (t == 0)).alias("true_negatives"),
        F.count_if((p == 0) & (t == 1)).alias("false_negatives"))
    return cm.select("*", *metric_columns("true_positives", "false_positives", "true_negatives",
                                          "false_negatives", "textbook")[:4])


def threshold_groups(results: DataFrame) -> DataFrame:
    """Tuned thresholds grouped by category in the fixed category order,
    ascending threshold inside a category (ties by registry order)."""
    r = with_registry(results.where("success"))
    w = Window.orderBy("category_rank", "optimal_threshold", "registry_pos")
    return r.select(F.row_number().over(w).alias("position"), "category", "model_key", "model_name",
                    "optimal_threshold")


def threshold_summary(results: DataFrame) -> DataFrame:
    """mean, upper median (sorted[n // 2]), min, max and range of tuned thresholds."""
    ok = results.where("success")
    s = ok.agg(F.avg("optimal_threshold").alias("mean_threshold"),
               F.min("optimal_threshold").alias("min_threshold"),
               F.max("optimal_threshold").alias("max_threshold"),
               F.count(F.lit(1)).alias("n_models"))
    w = Window.orderBy("optimal_threshold", "model_key")   # one row per model
    med = (ok.select("optimal_threshold", F.row_number().over(w).alias("_p"))
             .join(s.select("n_models"), F.col("_p") == F.floor(F.col("n_models") / 2) + 1)
             .select(F.col("optimal_threshold").alias("median_threshold")))
    return (s.crossJoin(med).withColumn("range_threshold", F.col("max_threshold") - F.col("min_threshold"))
             .drop("n_models"))


def metric_curves(scored: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """threshold -> F1 / precision / recall with textbook zero rules."""
    by = list(by or ["model_key"])
    sw = threshold_sweep(scored, grid, by, rules="textbook")
    return sw.select(*by, "threshold", "f1_score", "precision", "recall")


def pareto_thresholds(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Thresholds not strictly dominated on (precision, recall) within a group.

    The anti-join compares at most ``len(grid)`` rows per group with each
    other (equi-join on the group, bounded by the grid size)."""
    by = list(by or ["model_key"])
    a = sweep.select(*by, "threshold", "precision", "recall")
    b = a.select(*by, F.col("precision").alias("_p2"), F.col("recall").alias("_r2"))
    cond = [a[c] == b[c] for c in by] + [
        (b["_p2"] >= a["precision"]) & (b["_r2"] >= a["recall"]) &
        ((b["_p2"] > a["precision"]) | (b["_r2"] > a["recall"]))]
    return a.join(b, cond, "left_anti")


def fold_stability(scored: DataFrame, grid: list[float], fold_col: str = "fold", metric: str = "f1",
                   min_precision: float | None = None) -> DataFrame:
    """Tuned threshold per (model, fold), then mean and population std per model."""
    by = ["model_key", fold_col]
    sweep = threshold_sweep(scored, grid, by)
    best = best_threshold(sweep, by, metric, min_precision)
    return best.groupBy("model_key").agg(F.count(F.lit(1)).alias("n_folds"),
                                         F.avg("threshold").alias("mean_threshold"),
                                         F.stddev_pop("threshold").alias("std_threshold"),
                                         F.min("threshold").alias("min_threshold"),
                                         F.max("threshold").alias("max_threshold"))


def sample_size_stability(scored_ranked: DataFrame, sizes: list[int], grid: list[float],
                          rank_col: str = "_rank", metric: str = "f1",
                          min_precision: float | None = None) -> DataFrame:
    """Optimal threshold per model at nested sample sizes.

    ``scored_ranked`` carries the pair's sample rank (rank once); a row
    belongs to every size ``n >= rank``. ``explode`` of the admissible sizes
    replaces a cross join, so each row is copied only into sizes that use it.
    """
    sz = sorted(int(s) for s in sizes)
    arr = F.array(*[F.lit(s) for s in sz])
    x = scored_ranked.withColumn("sample_size", F.explode(F.filter(arr, lambda n: n >= F.col(rank_col))))
    by = ["model_key", "sample_size"]
    sweep = threshold_sweep(x, grid, by)
    best = best_threshold(sweep, by, metric, min_precision)
    return best.select(*by, F.col("threshold").alias("optimal_threshold"), "f1_score", "precision", "recall")
