"""Classification metrics over scored pairs, in one aggregate pass per group.

Scored pairs are the long table ``(model_key, pair_id, similarity,
is_duplicate)``; ``by`` names the grouping columns (usually the model key).
Two zero-division rule sets exist, as in the reference:

* ``textbook`` (the evaluator): any 0/0 ratio is 0, specificity 0 without
  negatives;
* ``tuner`` (the threshold tuner): if every prediction is positive, precision
  0 and recall 1; if every prediction is negative, precision 1 and recall 0;
  F1 is 0 in both cases (S13).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEDIAN_BUCKETS = 1 << 16


def classify(sim, threshold: float) -> Column:
    """Prediction: ``similarity >= threshold`` (inclusive) as 0/1."""
    s = F.col(sim) if isinstance(sim, str) else sim
    return (s >= F.lit(float(threshold))).cast("int")


def hit_predicate(distance, response, threshold: float) -> Column:
    """Cache hit: strict ``distance < threshold`` and a stored response."""
    d = F.col(distance) if isinstance(distance, str) else distance
    r = F.col(response) if isinstance(response, str) else response
    return (d < F.lit(float(threshold))) & r.isNotNull()


def outcome_cell(pred, truth) -> Column:
    p = F.col(pred) if isinstance(pred, str) else pred
    t = F.col(truth) if isinstance(truth, str) else truth
    return (F.when((p == 1) & (t == 1), "TP").when((p == 1) & (t == 0), "FP")
             .when((p == 0) & (t == 0), "TN").otherwise("FN"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def metric_columns(tp="tp", fp="fp", tn="tn", fn="fn", rules: str = "textbook") -> list[Column]:
    """accuracy, precision, recall, f1_score, specificity from the four cells."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in (tp, fp, tn, fn))
    total = tp + fp + tn + fn
    acc = _ratio(tp + tn, total)
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    if rules == "tuner":
        all_pos = (tp + fp) == total
        all_neg = (tp + fp) == 0
        prec = F.when(all_neg, 1.0).when(all_pos, 0.0).otherwise(prec)
        rec = F.when(all_neg, 0.0).when(all_pos, 1.0).otherwise(rec)
        f1 = F.when(all_neg | all_pos, 0.0).otherwise(f1)
    spec = _ratio(tn, tn + fp)
    return [acc.alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
            f1.alias("f1_score"), spec.alias("specificity")]


def confusion_matrix(scored: DataFrame, threshold: float, by: list[str] | None = None,
                     sim: str = "similarity", label: str = "is_duplicate") -> DataFrame:
    """TN, FP, FN, TP and total per group (always the full 2x2, S17)."""
    by = by or []
    p = classify(sim, threshold)
    t = F.col(label)
    aggs = [F.count_if((p == 0) & (t == 0)).alias("true_negatives"),
            F.count_if((p == 1) & (t == 0)).alias("false_positives"),
            F.count_if((p == 0) & (t == 1)).alias("false_negatives"),
            F.count_if((p == 1) & (t == 1)).alias("true_positives"),
            F.count(F.lit(1)).alias("total")]
    return scored.groupBy(*by).agg(*aggs)


def confusion_shares(cm: DataFrame) -> DataFrame:
    """Each confusion cell as a percentage of the total."""
    tot = F.col("total").cast("double")
    cells = ["true_negatives", "false_positives", "false_negatives", "true_positives"]
    return cm.select("*", *[F.when(tot > 0, F.col(c) / tot * 100).otherwise(0.0).alias(f"{c}_pct") for c in cells])


def classification_metrics(cm: DataFrame, rules: str = "textbook") -> DataFrame:
    return cm.select("*", *metric_columns("true_positives", "false_positives", "true_negatives",
                                          "false_negatives", rules))


def _moments(name: str, v: Column, when: Column | None = None) -> dict[str, tuple[str, Column]]:
    """Per-bucket parts of count, mean and population variance that add up over buckets."""
    x = v if when is None else F.when(when, v)
    n, total = F.count(x), F.sum(x)
    return {f"{name}_n": ("sum", n), f"{name}_s": ("sum", total), f"{name}_q": ("sum", n * F.var_pop(x)),
            f"{name}_r": ("sum", total * total / n), f"{name}_lo": ("min", F.min(x)), f"{name}_hi": ("max", F.max(x))}


def moment_columns(name: str, out: str, prefix=lambda c: F.col(c)) -> list[Column]:
    """mean, population std, min and max from added-up ``_moments``; null without a value."""
    n, total, inner, outer = (prefix(f"{name}_{x}") for x in "nsqr")
    var = F.greatest((inner + outer - total * total / n) / n, F.lit(0.0))
    return [F.when(n > 0, total / n).alias(f"{out}_mean"), F.when(n > 0, F.sqrt(var)).alias(f"{out}_std"),
            prefix(f"{name}_lo").alias(f"{out}_min"), prefix(f"{name}_hi").alias(f"{out}_max")]


def profile(scored: DataFrame, by: list[str], sim: str, parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per group: ``parts`` added up, and the true median of the valid scores as ``sim_median``.

    Scores are read twice. First one aggregate per (group, score bucket) has
    the parts of each bucket; windows over a group's buckets add them up and find the
    bucket or two of the middle ranks. Then only those buckets' scores are looked
    at, as distinct values with counts. The found buckets, at most two rows
    a group, are broadcast (a group is a model or a split of one)."""
    width = 2.0 / MEDIAN_BUCKETS
    v = F.when(F.col(sim).isNotNull() & ~F.isnan(sim), F.col(sim))
    bucket = F.least(F.greatest(F.floor((v + 1.0) / F.lit(width)), F.lit(0)), F.lit(MEDIAN_BUCKETS - 1)).cast("long")
    rows = scored.withColumn("_v", v).withColumn("_bk", F.when(v.isNotNull(), bucket))
    hist = rows.groupBy(*by, "_bk").agg(F.count("_v").alias("_c"), *[c.alias(n) for n, (_, c) in parts.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = group.orderBy("_bk")
    total = F.struct(*[getattr(F, how)(n).over(group).alias(n) for n, (how, _) in parts.items()])
    t = hist.select(*by, "_bk", "_c", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"),
                    F.sum("_c").over(group).alias("_n"), F.row_number().over(order).alias("_i"), total.alias("_total"))
    t = t.withColumn("_base", F.col("_cum") - F.col("_c"))
    middle = F.filter(F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")),
                      lambda r: (F.col("_n") > 0) & (r > F.col("_base")) & (r <= F.col("_cum")))
    # a group without a valid score is found by its first bucket, which is then the null one
    hit = t.withColumn("_ranks", middle).where((F.size("_ranks") > 0) | ((F.col("_n") == 0) & (F.col("_i") == 1)))
    hit = hit.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_bk").alias("_g__bk"), "_base", "_ranks", "_total")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*by, "_bk"]])
    found = rows.select(*by, "_bk", "_v").join(F.broadcast(hit), same)
    per = found.groupBy(*by, "_bk", "_v").agg(F.count(F.lit(1)).alias("_vc"), *[F.first(c).alias(c) for c in ("_base", "_ranks", "_total")])
    w = Window.partitionBy(*by, "_bk").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("_end", F.col("_base") + F.sum("_vc").over(w))
    times = F.size(F.filter("_ranks", lambda r: (r > F.col("_end") - F.col("_vc")) & (r <= F.col("_end"))))
    per = per.withColumn("_times", F.when(F.col("_v").isNotNull(), times).otherwise(0))
    out = per.groupBy(*by).agg(F.first("_total").alias("_total"),
                               (F.sum(F.when(F.col("_times") > 0, F.col("_v") * F.col("_times")))
                                / F.sum(F.when(F.col("_times") > 0, F.col("_times")))).alias("sim_median"))
    return out.select(*by, "_total.*", "sim_median")


def similarity_stats(scored: DataFrame, by: list[str] | None = None, sim: str = "similarity",
                     median: bool = True) -> DataFrame:
    """mean, population std, min, max and the true median per group."""
    by = by or []
    if not median:
        return scored.groupBy(*by).agg(F.avg(sim).alias("sim_mean"), F.stddev_pop(sim).alias("sim_std"),
                                       F.min(sim).alias("sim_min"), F.max(sim).alias("sim_max"))
    return profile(scored, by, sim, _moments("_m", F.col(sim))).select(*by, *moment_columns("_m", "sim"), "sim_median")


def cell_similarity(scored: DataFrame, threshold: float, by: list[str] | None = None,
                    sim: str = "similarity", label: str = "is_duplicate") -> DataFrame:
    """Mean similarity per TP/FP/TN/FN cell, 0 when the cell is empty."""
    by = by or []
    cell = outcome_cell(classify(sim, threshold), F.col(label))
    return scored.groupBy(*by).agg(*[
        F.coalesce(F.avg(F.when(cell == c, F.col(sim))), F.lit(0.0)).alias(f"avg_sim_{c.lower()}")
        for c in ("TP", "FP", "TN", "FN")])


def class_similarity(scored: DataFrame, by: list[str] | None = None, sim: str = "similarity",
                     label: str = "is_duplicate") -> DataFrame:
    """mean / population std / min / max of similarity by true class."""
    by = by or []
    return scored.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(sim).alias("mean"), F.stddev_pop(sim).alias("std"),
        F.min(sim).alias("min"), F.max(sim).alias("max"))


def evaluate_pairs(scored: DataFrame, threshold: float = 0.85, by: list[str] | None = None,
                   sim: str = "similarity", label: str = "is_duplicate", valid_only: bool = False) -> DataFrame:
    """The evaluator's full metric row per group: one aggregate pass for the
    counts, sums and moments, plus the exact median. With ``valid_only`` rows
    whose similarity is null are left out of every statistic (the group still
    appears, with ``n_samples = 0``)."""
    by = by or []
    p, t, s = classify(sim, threshold), F.col(label), F.col(sim)
    v = s.isNotNull() if valid_only else F.lit(True)
    cells = {"true_positives": v & (p == 1) & (t == 1), "false_positives": v & (p == 1) & (t == 0),
             "true_negatives": v & (p == 0) & (t == 0), "false_negatives": v & (p == 0) & (t == 1)}
    short = {"true_positives": "tp", "false_positives": "fp", "true_negatives": "tn", "false_negatives": "fn"}
    parts = {n: ("sum", F.count_if(c)) for n, c in cells.items()}
    parts |= {f"_s_{n}": ("sum", F.sum(F.when(c, s))) for n, c in cells.items()}
    parts |= {"n_samples": ("sum", F.count_if(v))} | _moments("_m", s)
    got = profile(scored, by, sim, parts)
    means = [F.when(F.col(n) > 0, F.col(f"_s_{n}") / F.col(n)).otherwise(0.0).alias(f"avg_sim_{short[n]}") for n in cells]
    cols = [*by, *cells, *means, "n_samples", *moment_columns("_m", "sim")]
    return got.select(*cols, *metric_columns("true_positives", "false_positives", "true_negatives", "false_negatives", "textbook"),
                      F.lit(float(threshold)).alias("threshold"), "sim_median")
