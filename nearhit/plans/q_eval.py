"""Classification metrics, threshold tuning, comparison and report tables over
``model_pairs`` (six prefix-"models" of the ``embeddings`` vectors)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from nearhit.functions.ids import hash32, hash32_sql
from nearhit.operators import compare as CM
from nearhit.operators import metrics as M
from nearhit.operators import registry as R
from nearhit.operators import report as RP
from nearhit.operators import sketch as SK
from nearhit.operators import tune as TU
from nearhit.operators.rank import hash_rank
from nearhit.plans import fixtures as X
from nearhit.plans.catalog import query, tidy
from nearhit.plans.sqlparts import best_sql, grid_sql, metrics_sql, ratio, sweep_sql, tidy_sql
from nearhit.session import ensure_checkpoint_dir

GRID = X.VECTOR_GRID
EVAL_T = 0.10          # fixed evaluation threshold on model_pairs
MIN_P = 0.12           # precision floor for constrained tuning
SEED = 42
BASE = X.with_ctes(X.MODEL_PAIRS_SQL, f"grid AS ({grid_sql(GRID)})")


def pairs(spark, sf):
    return X.model_pairs(spark, sf)


def q(s: str) -> str:
    return s.replace("'", "''")


# ----------------------------------------------------------------- 2.B / 2.H

@query("classify_pairs", BASE + tidy_sql(
    f"SELECT model_key, pair_id, CAST(similarity >= {EVAL_T} AS BIGINT) AS prediction FROM model_pairs", []))
def q_classify(spark, sf):
    p = pairs(spark, sf)
    return tidy(p.select("model_key", "pair_id", M.classify("similarity", EVAL_T).alias("prediction")))


CELL_SQL = f"""CASE WHEN similarity >= {EVAL_T} AND is_duplicate = 1 THEN 'TP'
  WHEN similarity >= {EVAL_T} AND is_duplicate = 0 THEN 'FP'
  WHEN similarity < {EVAL_T} AND is_duplicate = 0 THEN 'TN' ELSE 'FN' END"""


@query("outcome_cell", BASE + f"SELECT model_key, pair_id, {CELL_SQL} AS cell FROM model_pairs")
def q_cell(spark, sf):
    p = pairs(spark, sf)
    return p.select("model_key", "pair_id", M.outcome_cell(M.classify("similarity", EVAL_T), "is_duplicate").alias("cell"))


CM_SQL = f"""cm AS (SELECT model_key,
  count(*) FILTER (WHERE similarity < {EVAL_T} AND is_duplicate = 0) AS true_negatives,
  count(*) FILTER (WHERE similarity >= {EVAL_T} AND is_duplicate = 0) AS false_positives,
  count(*) FILTER (WHERE similarity < {EVAL_T} AND is_duplicate = 1) AS false_negatives,
  count(*) FILTER (WHERE similarity >= {EVAL_T} AND is_duplicate = 1) AS true_positives,
  count(*) AS total FROM model_pairs GROUP BY model_key)"""


@query("confusion_matrix", BASE + "," + CM_SQL + " SELECT * FROM cm")
def q_cm(spark, sf):
    return M.confusion_matrix(pairs(spark, sf), EVAL_T, ["model_key"])


SHARES = ", ".join(f"{ratio(c, 'total')} * 100 AS {c}_pct" for c in
                   ["true_negatives", "false_positives", "false_negatives", "true_positives"])


@query("confusion_shares", BASE + "," + CM_SQL + tidy_sql(
    f"SELECT *, {SHARES} FROM cm",
    [f"{c}_pct" for c in ["true_negatives", "false_positives", "false_negatives", "true_positives"]]))
def q_cm_shares(spark, sf):
    return tidy(M.confusion_shares(M.confusion_matrix(pairs(spark, sf), EVAL_T, ["model_key"])))


MET = ["accuracy", "precision", "recall", "f1_score", "specificity"]


@query("classification_metrics", BASE + "," + CM_SQL + tidy_sql(f"SELECT *, {metrics_sql()} FROM cm", MET))
def q_metrics(spark, sf):
    return tidy(M.classification_metrics(M.confusion_matrix(pairs(spark, sf), EVAL_T, ["model_key"])))


MEDIAN_SQL = "median(similarity)"
STATS_SQL = f"""SELECT model_key, avg(similarity) AS sim_mean, stddev_pop(similarity) AS sim_std,
  min(similarity) AS sim_min, max(similarity) AS sim_max, {MEDIAN_SQL} AS sim_median
  FROM model_pairs GROUP BY model_key"""


@query("similarity_stats", BASE + tidy_sql(STATS_SQL, ["sim_mean", "sim_std", "sim_min", "sim_max", "sim_median"]))
def q_sim_stats(spark, sf):
    return tidy(M.similarity_stats(pairs(spark, sf), ["model_key"]))


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
NEAR = [f"{SK.column(p)}_near" for p in PROBS]


@query("similarity_sketch", BASE + tidy_sql(f"""SELECT model_key, count(*) AS n, avg(similarity) AS sim_mean, stddev_pop(similarity) AS sim_std,
  min(similarity) AS sim_min, max(similarity) AS sim_max, {", ".join(f"CAST(1 AS BIGINT) AS {c}" for c in NEAR)}
  FROM model_pairs GROUP BY model_key""", ["sim_mean", "sim_std", "sim_min", "sim_max"]))
def q_sketch(spark, sf):
    """Sketches by model, class and half of the pairs, stored in two runs, merged by model; the ranks of the
    quantiles are then counted in the scores and must lie within twice the stated error."""
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    p = pairs(spark, sf)
    for half in (0, 1):
        SK.append_sketches(SK.score_sketches(p.where(F.pmod(hash32(SEED, "pair_id"), F.lit(2)) == half), ["model_key", "is_duplicate"]), path)
    found = SK.quantiles(SK.merge_sketches(SK.read_sketches(spark, path), ["model_key"]), ["model_key"], PROBS)
    errors = SK.rank_errors(p, found, ["model_key"], PROBS)
    near = [(F.col(f"{SK.column(x)}_error") <= 2 * SK.rank_error()).alias(c) for x, c in zip(PROBS, NEAR)]
    return tidy(found.drop(*[SK.column(x) for x in PROBS]).join(errors.select("model_key", *near), "model_key"))


def _cell_avg(cell):
    return f"coalesce(avg(similarity) FILTER (WHERE ({CELL_SQL}) = '{cell}'), 0.0) AS avg_sim_{cell.lower()}"


CELLS_SQL = "SELECT model_key, " + ", ".join(_cell_avg(c) for c in ("TP", "FP", "TN", "FN")) + \
    " FROM model_pairs GROUP BY model_key"


@query("cell_similarity", BASE + tidy_sql(CELLS_SQL, ["avg_sim_tp", "avg_sim_fp", "avg_sim_tn", "avg_sim_fn"]))
def q_cell_sim(spark, sf):
    return tidy(M.cell_similarity(pairs(spark, sf), EVAL_T, ["model_key"]))


@query("class_similarity", BASE + tidy_sql(
    """SELECT model_key, is_duplicate, count(*) AS n, avg(similarity) AS mean, stddev_pop(similarity) AS std,
       min(similarity) AS min, max(similarity) AS max FROM model_pairs GROUP BY model_key, is_duplicate""",
    ["mean", "std", "min", "max"], ints=["is_duplicate"]))
def q_class_sim(spark, sf):
    return tidy(M.class_similarity(pairs(spark, sf), ["model_key"]))


EVAL_COLS = ["accuracy", "precision", "recall", "f1_score", "specificity", "threshold", "sim_mean", "sim_std",
             "sim_min", "sim_max", "sim_median", "avg_sim_tp", "avg_sim_fp", "avg_sim_tn", "avg_sim_fn"]
EVAL_SQL = f"""ev AS (SELECT *, {metrics_sql()}, CAST({EVAL_T} AS DOUBLE) AS threshold FROM (
  SELECT model_key,
    count(*) FILTER (WHERE ({CELL_SQL}) = 'TP') AS true_positives,
    count(*) FILTER (WHERE ({CELL_SQL}) = 'FP') AS false_positives,
    count(*) FILTER (WHERE ({CELL_SQL}) = 'TN') AS true_negatives,
    count(*) FILTER (WHERE ({CELL_SQL}) = 'FN') AS false_negatives,
    {", ".join(_cell_avg(c) for c in ("TP", "FP", "TN", "FN"))},
    count(*) AS n_samples, avg(similarity) AS sim_mean, stddev_pop(similarity) AS sim_std,
    min(similarity) AS sim_min, max(similarity) AS sim_max, {MEDIAN_SQL} AS sim_median
  FROM model_pairs GROUP BY model_key) AS _e)"""


@query("evaluate_pairs", BASE + "," + EVAL_SQL + tidy_sql("SELECT * FROM ev", EVAL_COLS))
def q_evaluate(spark, sf):
    return tidy(M.evaluate_pairs(pairs(spark, sf), EVAL_T, ["model_key"]))


# ----------------------------------------------------------------- 2.I sweep / best

SW_COLS = ["threshold", "accuracy", "precision", "recall", "f1_score", "specificity"]
SWEEP_CTE = f"sw AS ({sweep_sql('model_pairs', ['model_key'])})"


@query("threshold_sweep", BASE + "," + SWEEP_CTE + tidy_sql("SELECT * FROM sw", SW_COLS))
def q_sweep(spark, sf):
    return tidy(TU.threshold_sweep(pairs(spark, sf), GRID, ["model_key"]))


@query("best_threshold", BASE + "," + SWEEP_CTE + tidy_sql(best_sql("sw", ["model_key"], "f1"), SW_COLS))
def q_best(spark, sf):
    sw = TU.threshold_sweep(pairs(spark, sf), GRID, ["model_key"])
    return tidy(TU.best_threshold(sw, ["model_key"], "f1"))


TUNE_DOUBLES = ["optimal_threshold", "accuracy", "precision", "recall", "f1_score", "dup_mean", "dup_std",
                "dup_min", "dup_max", "nondup_mean", "nondup_std", "nondup_min", "nondup_max",
                "min_precision_constraint"]


def tune_sql(src: str, metric: str, min_precision, prefix: str = "t") -> str:
    """CTEs ending in ``{prefix}_res`` with the columns of ``tune_models``."""
    valid = "similarity IS NOT NULL AND NOT isnan(similarity)"
    d, n = "is_duplicate = 1", "is_duplicate = 0"

    def st(f, cond, name):
        return f"{f}(similarity) FILTER (WHERE {cond}) AS {name}"
    cls = ", ".join([st("avg", d, "dup_mean"), st("stddev_pop", d, "dup_std"), st("min", d, "dup_min"),
                     st("max", d, "dup_max"), st("avg", n, "nondup_mean"), st("stddev_pop", n, "nondup_std"),
                     st("min", n, "nondup_min"), st("max", n, "nondup_max")])
    mp = "NULL" if min_precision is None else repr(float(min_precision))
    ok_cols = ["optimal_threshold", "accuracy", "precision", "recall", "f1_score", "true_negatives",
               "false_positives", "false_negatives", "true_positives", "total", "dup_mean", "dup_std", "dup_min",
               "dup_max", "nondup_mean", "nondup_std", "nondup_min", "nondup_max", "valid_samples",
               "invalid_samples"]
    sel = ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in ok_cols)
    return f""",
{prefix}_sw AS ({sweep_sql(src, ['model_key'])}),
{prefix}_best AS ({best_sql(prefix + '_sw', ['model_key'], metric, min_precision)}),
{prefix}_cls AS (SELECT model_key, count(*) FILTER (WHERE {d}) AS _nd, count(*) FILTER (WHERE {n}) AS _nn, {cls}
  FROM {src} WHERE {valid} GROUP BY model_key),
{prefix}_cnt AS (SELECT model_key, count(*) AS tuning_samples, count(*) FILTER (WHERE {valid}) AS valid_samples,
  count(*) FILTER (WHERE NOT ({valid})) AS invalid_samples FROM {src} GROUP BY model_key),
{prefix}_j AS (SELECT c.*, k.* EXCLUDE (model_key), b.threshold AS optimal_threshold, b.accuracy, b.precision,
  b.recall, b.f1_score, b.true_negatives, b.false_positives, b.false_negatives, b.true_positives, b.total,
  CASE WHEN c.valid_samples = 0 THEN '{q(TU.ALL_INVALID_ERROR)}'
       WHEN b.threshold IS NULL THEN '{q(TU.no_threshold_error(min_precision))}'
       WHEN k._nd = 0 OR k._nn = 0 THEN '{q(TU.EMPTY_CLASS_ERROR)}' END AS error
  FROM {prefix}_cnt c LEFT JOIN {prefix}_cls k USING (model_key) LEFT JOIN {prefix}_best b USING (model_key)),
{prefix}_res AS (SELECT model_key, tuning_samples, {sel}, '{metric}' AS optimization_metric,
  CAST({mp} AS DOUBLE) AS min_precision_constraint, error IS NULL AS success, error FROM {prefix}_j)
"""


TUNE_SQL = BASE + tune_sql("model_pairs", "f1", MIN_P)


def tuned(spark, sf):
    return TU.tune_models(pairs(spark, sf), GRID, "f1", MIN_P)


@query("tune_models", TUNE_SQL + tidy_sql("SELECT * FROM t_res", TUNE_DOUBLES, bools=["success"]))
def q_tune_models(spark, sf):
    return tidy(tuned(spark, sf))


@query("tune_model", BASE + ", one AS (SELECT * FROM model_pairs WHERE model_key = 'mpnet-base')"
       + tune_sql("one", "accuracy", None) + tidy_sql("SELECT * FROM t_res", TUNE_DOUBLES, bools=["success"]))
def q_tune_model(spark, sf):
    one = R.models_in_scope(pairs(spark, sf), keys=["mpnet-base"])
    return tidy(TU.tune_models(one, GRID, "accuracy", None))


@query("optimal_thresholds", TUNE_SQL + tidy_sql(
    "SELECT model_key, optimal_threshold FROM t_res WHERE success", ["optimal_threshold"]))
def q_optimal(spark, sf):
    return tidy(TU.optimal_thresholds(tuned(spark, sf)))


REG_CTE = f"reg AS ({R.registry_sql()})"
RANK_SQL = TUNE_SQL + "," + REG_CTE + """
SELECT row_number() OVER (ORDER BY round(t.f1_score, 4) DESC, r.registry_pos) AS position, t.model_key,
  r.model_name, r.category, t.optimal_threshold, t.accuracy, t.precision, t.recall, t.f1_score,
  CAST(row_number() OVER (ORDER BY t.f1_score DESC, r.registry_pos) = 1 AS BIGINT) AS is_best
FROM t_res t LEFT JOIN reg r USING (model_key) WHERE t.success"""


@query("tuning_ranking", tidy_sql(RANK_SQL, ["optimal_threshold", "accuracy", "precision", "recall", "f1_score"]))
def q_tuning_ranking(spark, sf):
    return tidy(TU.tuning_ranking(tuned(spark, sf)))


def _strategy_sql():
    parts = []
    for name, metric, mp in TU.STRATEGIES:
        b = best_sql("sw", ["model_key"], metric, MIN_P if mp else None)
        parts.append(f"SELECT model_key, '{name}' AS strategy, threshold, f1_score FROM ({b})")
    u = " UNION ALL ".join(parts)
    cols = ", ".join(f"max(threshold) FILTER (WHERE strategy = '{n}') AS {n}_threshold, "
                     f"max(f1_score) FILTER (WHERE strategy = '{n}') AS {n}_f1" for n, _, _ in TU.STRATEGIES)
    return f"SELECT model_key, {cols} FROM ({u}) GROUP BY model_key"


STRAT_DOUBLES = [f"{n}_{c}" for n, _, _ in TU.STRATEGIES for c in ("threshold", "f1")]


@query("strategy_comparison", BASE + "," + SWEEP_CTE + tidy_sql(_strategy_sql(), STRAT_DOUBLES))
def q_strategy(spark, sf):
    return tidy(TU.strategy_comparison(pairs(spark, sf), GRID, MIN_P))


# hash split of pairs: 50 / 30 / 20
def split_col(id_col="pair_id", seed=SEED):
    u = hash32(seed, id_col) / F.lit(4294967296.0)
    return F.when(u < 0.5, "train").when(u < 0.8, "val").otherwise("test")


def split_sql(id_col="pair_id", seed=SEED):
    u = f"({hash32_sql(seed, id_col)} / 4294967296.0)"
    return f"CASE WHEN {u} < 0.5 THEN 'train' WHEN {u} < 0.8 THEN 'val' ELSE 'test' END"


TTV_SQL = BASE + f", sp AS (SELECT *, {split_sql()} AS split FROM model_pairs), tr AS (SELECT * FROM sp WHERE split = 'train')" \
    + tune_sql("tr", "f1", None) + f"""
SELECT * REPLACE (round(accuracy, 6) + 0.0 AS accuracy, round(precision, 6) + 0.0 AS precision,
  round(recall, 6) + 0.0 AS recall, round(f1_score, 6) + 0.0 AS f1_score, round(tuned_threshold, 6) + 0.0 AS tuned_threshold)
FROM (SELECT *, {metrics_sql(spec=False)} FROM (
  SELECT s.model_key, s.split, t.optimal_threshold AS tuned_threshold,
    count(*) FILTER (WHERE s.similarity >= t.optimal_threshold AND s.is_duplicate = 1) AS true_positives,
    count(*) FILTER (WHERE s.similarity >= t.optimal_threshold AND s.is_duplicate = 0) AS false_positives,
    count(*) FILTER (WHERE s.similarity < t.optimal_threshold AND s.is_duplicate = 0) AS true_negatives,
    count(*) FILTER (WHERE s.similarity < t.optimal_threshold AND s.is_duplicate = 1) AS false_negatives
  FROM sp s JOIN t_res t ON t.model_key = s.model_key AND t.success
  WHERE s.split IN ('val', 'test')
  GROUP BY s.model_key, s.split, t.optimal_threshold))"""


@query("tune_then_validate", TTV_SQL)
def q_ttv(spark, sf):
    p = pairs(spark, sf).withColumn("split", split_col())
    res = TU.tune_then_validate(p.where(F.col("split") == "train"), p.where(F.col("split").isin("val", "test")), GRID)
    return tidy(res)


@query("threshold_groups", TUNE_SQL + "," + REG_CTE + tidy_sql("""
SELECT row_number() OVER (ORDER BY r.category_rank, t.optimal_threshold, r.registry_pos) AS position,
  r.category, t.model_key, r.model_name, t.optimal_threshold
FROM t_res t LEFT JOIN reg r USING (model_key) WHERE t.success""", ["optimal_threshold"]))
def q_threshold_groups(spark, sf):
    return tidy(TU.threshold_groups(tuned(spark, sf)))


@query("threshold_summary", TUNE_SQL + tidy_sql("""
SELECT s.mean_threshold, s.min_threshold, s.max_threshold, m.optimal_threshold AS median_threshold,
  s.max_threshold - s.min_threshold AS range_threshold
FROM (SELECT avg(optimal_threshold) AS mean_threshold, min(optimal_threshold) AS min_threshold,
        max(optimal_threshold) AS max_threshold, count(*) AS n FROM t_res WHERE success) s
JOIN (SELECT optimal_threshold, row_number() OVER (ORDER BY optimal_threshold, model_key) AS p
      FROM t_res WHERE success) m ON m.p = s.n // 2 + 1""",
    ["mean_threshold", "min_threshold", "max_threshold", "median_threshold", "range_threshold"]))
def q_threshold_summary(spark, sf):
    return tidy(TU.threshold_summary(tuned(spark, sf)))


SIZES = [500, 1000, 2000, 5000]


@query("sample_size_stability", BASE + f""",
pr AS (SELECT pair_id, row_number() OVER (ORDER BY {hash32_sql(SEED, 'pair_id')}, pair_id) AS _rank
       FROM (SELECT DISTINCT pair_id FROM model_pairs)),
sz AS (SELECT * FROM (VALUES {", ".join(f"({s})" for s in SIZES)}) AS s(sample_size)),
x AS (SELECT m.*, sz.sample_size FROM model_pairs m JOIN pr USING (pair_id) JOIN sz ON pr._rank <= sz.sample_size),
ssw AS ({sweep_sql('x', ['model_key', 'sample_size'])})
""" + tidy_sql(f"""SELECT model_key, sample_size, threshold AS optimal_threshold, f1_score, precision, recall
FROM ({best_sql('ssw', ['model_key', 'sample_size'], 'f1', MIN_P)})""",
               ["optimal_threshold", "f1_score", "precision", "recall"], ints=["sample_size"]))
def q_sample_size(spark, sf):
    p = pairs(spark, sf)
    ranks = hash_rank(p.select("pair_id").distinct(), SEED, "pair_id")
    x = p.join(ranks, "pair_id")
    return tidy(TU.sample_size_stability(x, SIZES, GRID, min_precision=MIN_P))


K_FOLDS = 5


@query("fold_stability", BASE + f""",
x AS (SELECT *, {hash32_sql(SEED, 'pair_id')} % {K_FOLDS} AS fold FROM model_pairs),
fsw AS ({sweep_sql('x', ['model_key', 'fold'])})
""" + tidy_sql(f"""SELECT model_key, count(*) AS n_folds, avg(threshold) AS mean_threshold,
  stddev_pop(threshold) AS std_threshold, min(threshold) AS min_threshold, max(threshold) AS max_threshold
FROM ({best_sql('fsw', ['model_key', 'fold'], 'f1', None)}) GROUP BY model_key""",
               ["mean_threshold", "std_threshold", "min_threshold", "max_threshold"]))
def q_fold_stability(spark, sf):
    p = pairs(spark, sf).withColumn("fold", F.pmod(hash32(SEED, "pair_id"), F.lit(K_FOLDS)))
    return tidy(TU.fold_stability(p, GRID))


@query("metric_curves", BASE + f", csw AS ({sweep_sql('model_pairs', ['model_key'], 'textbook')})" + tidy_sql(
    "SELECT model_key, threshold, f1_score, precision, recall FROM csw", ["threshold", "f1_score", "precision", "recall"]))
def q_curves(spark, sf):
    return tidy(TU.metric_curves(pairs(spark, sf), GRID))


@query("pareto_thresholds", BASE + "," + SWEEP_CTE + tidy_sql("""
SELECT a.model_key, a.threshold, a.precision, a.recall FROM sw a
WHERE NOT EXISTS (SELECT 1 FROM sw b WHERE b.model_key = a.model_key AND b.precision >= a.precision
  AND b.recall >= a.recall AND (b.precision > a.precision OR b.recall > a.recall))""",
    ["threshold", "precision", "recall"]))
def q_pareto(spark, sf):
    sw = TU.threshold_sweep(pairs(spark, sf), GRID, ["model_key"])
    return tidy(TU.pareto_thresholds(sw))


SPOILT_SQL = """spoilt AS (SELECT model_key, pair_id, is_duplicate,
  CASE WHEN pair_id % 50 = 1 THEN NULL WHEN pair_id % 51 = 2 THEN 'nan'::DOUBLE ELSE similarity END AS similarity FROM model_pairs)"""


def spoilt(spark, sf):
    """``model_pairs`` with some scores missing and some not a number."""
    s = F.when(F.col("pair_id") % 50 != 1, F.when(F.col("pair_id") % 51 == 2, F.lit(float("nan"))).otherwise(F.col("similarity")))
    return pairs(spark, sf).withColumn("similarity", s)


@query("valid_scores", BASE + "," + SPOILT_SQL + """
SELECT model_key, count(*) AS tuning_samples,
  count(*) FILTER (WHERE similarity IS NOT NULL AND NOT isnan(similarity)) AS valid_samples,
  count(*) FILTER (WHERE similarity IS NULL OR isnan(similarity)) AS invalid_samples,
  CAST(count(*) FILTER (WHERE similarity IS NOT NULL AND NOT isnan(similarity)) < 100 AS BIGINT) AS few_valid
FROM spoilt GROUP BY model_key""")
def q_valid(spark, sf):
    return tidy(TU.score_validity(spoilt(spark, sf), ["model_key"]))


# ----------------------------------------------------------------- 2.L scope / registry

@query("models_in_scope", BASE + "," + REG_CTE + tidy_sql(
    "SELECT model_key, pair_id, similarity, is_duplicate FROM model_pairs "
    "WHERE model_key IN (SELECT model_key FROM reg WHERE category = 'fast')", ["similarity"], ints=["is_duplicate"]))
def q_scope(spark, sf):
    p = pairs(spark, sf).select("model_key", "pair_id", "similarity", "is_duplicate")
    return tidy(R.models_in_scope(p, category="fast"))


@query("unknown_models", BASE + "," + REG_CTE + """, ds AS (SELECT * FROM model_pairs UNION ALL
  SELECT 'hashed-' || model_key, pair_id, vec_a, vec_b, similarity, is_duplicate FROM model_pairs WHERE model_key = 'labse')
SELECT DISTINCT model_key FROM ds WHERE model_key NOT IN (SELECT model_key FROM reg)""")
def q_unknown(spark, sf):
    p = pairs(spark, sf)
    extra = p.where(F.col("model_key") == "labse").withColumn("model_key", F.concat(F.lit("hashed-"), F.col("model_key")))
    return R.unknown_models(p.unionByName(extra))


@query("registry_join", TUNE_SQL + "," + REG_CTE + tidy_sql(
    """SELECT t.model_key, r.model_name, r.category, r.dimension, t.optimal_threshold, t.f1_score
    FROM t_res t LEFT JOIN reg r USING (model_key)""", ["optimal_threshold", "f1_score"], ints=["dimension"]))
def q_registry_join(spark, sf):
    t = tuned(spark, sf).select("model_key", "optimal_threshold", "f1_score")
    return tidy(R.registry_join(t).select("model_key", "model_name", "category", "dimension",
                                          "optimal_threshold", "f1_score"))


# ----------------------------------------------------------------- 2.J comparison

CMP_SQL = BASE + "," + EVAL_SQL + "," + REG_CTE + """,
cmp AS (SELECT k.model_key, r.model_name, r.dimension, r.category, r.registry_pos, r.category_rank, e.* EXCLUDE (model_key),
  e.n_samples IS NOT NULL AS success, CASE WHEN e.n_samples IS NULL THEN 'no valid similarity scores' END AS error
  FROM (SELECT DISTINCT model_key FROM model_pairs) k LEFT JOIN ev e USING (model_key) LEFT JOIN reg r USING (model_key))
"""


def compared(spark, sf):
    return CM.compare_models(pairs(spark, sf), EVAL_T)


@query("compare_models", CMP_SQL + tidy_sql("SELECT * FROM cmp", EVAL_COLS, bools=["success"],
                                            ints=["dimension", "registry_pos", "category_rank"]))
def q_compare(spark, sf):
    return tidy(compared(spark, sf))


@query("comparison_ranking", CMP_SQL + tidy_sql("""
SELECT row_number() OVER (ORDER BY round(f1_score, 4) DESC, registry_pos) AS position, model_name, category, dimension,
  round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1_score, 4) AS f1_score FROM cmp WHERE success""", ["accuracy", "precision", "recall", "f1_score"],
    ints=["dimension"]))
def q_cmp_rank(spark, sf):
    return tidy(CM.comparison_ranking(compared(spark, sf)))


def _leaders_sql():
    u = " UNION ALL ".join(f"SELECT '{a}' AS award, model_key, model_name, {c} AS value, registry_pos FROM cmp WHERE success"
                           for a, c in CM.LEADERS)
    return f"""SELECT award, model_key, model_name, value FROM (
  SELECT *, row_number() OVER (PARTITION BY award ORDER BY value DESC, registry_pos) AS rn FROM ({u})) WHERE rn = 1"""


@query("comparison_leaders", CMP_SQL + tidy_sql(_leaders_sql(), ["value"]))
def q_cmp_leaders(spark, sf):
    return tidy(CM.comparison_leaders(compared(spark, sf)))


@query("comparison_flat", CMP_SQL + tidy_sql("""
SELECT model_key, model_name, category, dimension, accuracy, precision, recall, f1_score, specificity,
  true_positives, true_negatives, false_positives, false_negatives, CAST(NULL AS DOUBLE) AS evaluation_time,
  CAST(NULL AS DOUBLE) AS total_time FROM cmp WHERE success""",
    ["accuracy", "precision", "recall", "f1_score", "specificity", "evaluation_time", "total_time"], ints=["dimension"]))
def q_cmp_flat(spark, sf):
    return tidy(CM.comparison_flat(compared(spark, sf)))


# ----------------------------------------------------------------- 2.K report tables

FLAT_SQL = TUNE_SQL + "," + REG_CTE + """,
flat AS (SELECT r.model_name, t.model_key, r.category, r.dimension, t.optimal_threshold AS threshold, t.accuracy,
  t.precision, t.recall, t.f1_score, coalesce(t.true_negatives, 0) AS tn, coalesce(t.false_positives, 0) AS fp,
  coalesce(t.false_negatives, 0) AS fn, coalesce(t.true_positives, 0) AS tp, r.registry_pos
  FROM t_res t LEFT JOIN reg r USING (model_key) WHERE t.success)
"""
FLAT_D = ["threshold", "accuracy", "precision", "recall", "f1_score"]


def flat(spark, sf):
    return RP.report_flat(tuned(spark, sf))


@query("report_flat", FLAT_SQL + tidy_sql("SELECT * FROM flat", FLAT_D, ints=["dimension", "registry_pos"]))
def q_report_flat(spark, sf):
    return tidy(flat(spark, sf))


@query("thresholds_by_category", FLAT_SQL + tidy_sql(
    "SELECT row_number() OVER (ORDER BY category, threshold, registry_pos) AS position, category, model_key, threshold FROM flat",
    ["threshold"]))
def q_thr_cat(spark, sf):
    return tidy(RP.thresholds_by_category(flat(spark, sf)))


@query("metrics_by_f1", FLAT_SQL + tidy_sql(
    "SELECT row_number() OVER (ORDER BY f1_score ASC, registry_pos) AS position, model_key, precision, recall, f1_score FROM flat",
    ["precision", "recall", "f1_score"]))
def q_metrics_f1(spark, sf):
    return tidy(RP.metrics_by_f1(flat(spark, sf)))


TOP_N = 5


def _top_sql(n):
    return f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY f1_score DESC, registry_pos) AS rank, model_key, category,
  dimension, threshold, precision, recall, f1_score FROM flat) WHERE rank <= {n}"""


@query("top_models", FLAT_SQL + tidy_sql(_top_sql(TOP_N), ["threshold", "precision", "recall", "f1_score"],
                                        ints=["dimension"]))
def q_top(spark, sf):
    return tidy(RP.top_models(flat(spark, sf), TOP_N))


@query("top_confusions", FLAT_SQL + tidy_sql(f"""
SELECT t.rank, t.model_key, c.actual, c.predicted, c.count FROM ({_top_sql(6)}) t JOIN flat f USING (model_key),
LATERAL (SELECT * FROM (VALUES ('neg', 'neg', f.tn), ('neg', 'pos', f.fp), ('pos', 'neg', f.fn), ('pos', 'pos', f.tp))
         AS v(actual, predicted, count)) c""", [], ints=["count"]))
def q_top_conf(spark, sf):
    return tidy(RP.top_confusions(flat(spark, sf), 6))


@query("category_means", FLAT_SQL + tidy_sql(
    "SELECT category, avg(precision) AS precision, avg(recall) AS recall, avg(f1_score) AS f1_score, "
    "avg(threshold) AS threshold FROM flat GROUP BY category", ["precision", "recall", "f1_score", "threshold"]))
def q_cat_means(spark, sf):
    return tidy(RP.category_means(flat(spark, sf)))


_OV = ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in ("f1_score", "precision", "recall", "threshold"))


@query("overall_stats", FLAT_SQL + tidy_sql(
    f"SELECT {_OV}, min(threshold) AS min_threshold, max(threshold) AS max_threshold, count(*) AS n_models FROM flat",
    [f"{p}_{c}" for c in ("f1_score", "precision", "recall", "threshold") for p in ("mean", "std")]
    + ["min_threshold", "max_threshold"]))
def q_overall(spark, sf):
    return tidy(RP.overall_stats(flat(spark, sf)))


def _best_sql():
    parts = [f"""SELECT '{a}' AS award, model_key, f1_score, precision, recall FROM (
  SELECT *, row_number() OVER (ORDER BY {c} DESC, registry_pos) AS rn FROM flat) WHERE rn = 1"""
             for a, c in (("best_f1", "f1_score"), ("best_precision", "precision"), ("best_recall", "recall"))]
    return " UNION ALL ".join(parts)


@query("report_best", FLAT_SQL + tidy_sql(_best_sql(), ["f1_score", "precision", "recall"]))
def q_report_best(spark, sf):
    return tidy(RP.report_best(flat(spark, sf)))


@query("category_tables", FLAT_SQL + tidy_sql(
    """SELECT category, row_number() OVER (PARTITION BY category ORDER BY f1_score DESC, registry_pos) AS position,
    model_key, dimension, threshold, precision, recall, f1_score FROM flat""",
    ["threshold", "precision", "recall", "f1_score"], ints=["dimension"]))
def q_cat_tables(spark, sf):
    return tidy(RP.category_tables(flat(spark, sf)))
