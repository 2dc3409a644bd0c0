"""Sources and sinks as round trips through the shared scratch folder
(``spark.checkpoint.dir``): write the derived table, read it back with the
library's reader, and compare what comes back with the SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nearhit.operators import datasets as D
from nearhit.operators import store as S
from nearhit.plans import fixtures as X
from nearhit.plans import q_data, q_eval, q_text
from nearhit.plans.catalog import query, tidy
from nearhit.plans.sqlparts import tidy_sql
from nearhit.session import ensure_checkpoint_dir
from nearhit.sources import pairs as P
from nearhit.sources import results as N
from nearhit.sources.tables import table


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


PAIRS_BACK_SQL = X.with_ctes(X.QUESTION_PAIRS_SQL) + """SELECT id, qid1, qid2, md5(question1) AS q1_md5,
  md5(question2) AS q2_md5, CAST(is_duplicate AS BIGINT) AS is_duplicate FROM question_pairs"""


def pairs_back(spark, sf, splittable):
    path = scratch(spark)
    qp = X.question_pairs(spark, sf)
    (qp.write.mode("overwrite").option("header", True).option("escape", "\\").option("quote", '"')
       .option("escapeQuotes", True).csv(path))
    back = P.read_pairs(spark, path=path, splittable=splittable)
    return tidy(back.select("id", "qid1", "qid2", F.md5("question1").alias("q1_md5"),
                            F.md5("question2").alias("q2_md5"), "is_duplicate"))


@query("read_pairs", PAIRS_BACK_SQL)
def q_read_pairs(spark, sf):
    return pairs_back(spark, sf, False)


@query("read_pairs_split", PAIRS_BACK_SQL)
def q_read_pairs_split(spark, sf):
    return pairs_back(spark, sf, True)


@query("write_splits", X.with_ctes(X.QUESTION_PAIRS_SQL) + f"""SELECT split, count(*) AS rows,
  count(*) FILTER (WHERE is_duplicate = 1) AS duplicates FROM (
  SELECT *, {q_data.SPLIT_SQL} AS split FROM question_pairs WHERE {q_data.KEEP_SQL}) GROUP BY split""")
def q_write_splits(spark, sf):
    path = scratch(spark)
    df = D.split_three_way(D.clean_pairs(X.question_pairs(spark, sf)), seed=q_data.SEED)
    P.write_splits(df, path)
    parts = [P.read_split(spark, path, s).groupBy().agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("rows"),
                                                        F.count_if(F.col("is_duplicate") == 1).alias("duplicates"))
             for s in ("train", "val", "test")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(F.col("rows") > 0)


@query("write_paraphrases", "WITH " + q_text.PAIRS_SQL + " SELECT statement, semantically_same_statement FROM pp")
def q_write_para(spark, sf):
    path = scratch(spark)
    b, v = q_text.variants(spark, sf)
    from nearhit.operators.paraphrase import paraphrase_pairs
    P.write_paraphrases(paraphrase_pairs(b, v), path)
    return spark.read.option("header", True).csv(path)


RESULT_DDL = ("model_key string, tuning_samples long, optimal_threshold double, accuracy double, precision double, "
              "recall double, f1_score double, true_negatives long, false_positives long, false_negatives long, "
              "true_positives long, total long, valid_samples long, invalid_samples long, "
              "optimization_metric string, min_precision_constraint double, success boolean, error string")
RESULT_COLS = [c.split()[0] for c in RESULT_DDL.split(", ")]


@query("write_results_json", q_eval.TUNE_SQL + tidy_sql(
    f"SELECT {', '.join(RESULT_COLS)} FROM t_res",
    ["optimal_threshold", "accuracy", "precision", "recall", "f1_score", "min_precision_constraint"], bools=["success"]))
def q_results_json(spark, sf):
    path = scratch(spark)
    P.write_results_json(q_eval.tuned(spark, sf), path)
    return tidy(P.read_results_json(spark, path, RESULT_DDL))


@query("read_results_json", q_eval.TUNE_SQL + """SELECT model_key, optimization_metric, tuning_samples
FROM t_res WHERE success ORDER BY model_key LIMIT 1""")
def q_results_first(spark, sf):
    path = scratch(spark)
    P.write_results_json(q_eval.tuned(spark, sf), path)
    r = P.read_results_json(spark, path, RESULT_DDL)
    return P.first_success(r).select("model_key", "optimization_metric", "tuning_samples")


NESTED_COLS = ["optimal_threshold", *N.CONFIG, *N.METRICS, *N.CELLS, *(f"{c}_{s}" for c in N.CLASSES.values() for s in N.STATISTICS)]
NESTED_DOUBLES = ["optimal_threshold", "min_precision_constraint", *N.METRICS,
                  *(f"{c}_{s}" for c in N.CLASSES.values() for s in N.STATISTICS)]


@query("read_results_nested", q_eval.TUNE_SQL + tidy_sql(
    "SELECT row_number() OVER (ORDER BY model_key) - 1 AS place, model_key, success, CASE WHEN NOT success THEN error END AS error, "
    + ", ".join(f"CASE WHEN success THEN {c} END AS {c}" for c in NESTED_COLS) + " FROM t_res", NESTED_DOUBLES, bools=["success"]))
def q_results_nested(spark, sf):
    path = scratch(spark)
    N.write_nested_results(q_eval.tuned(spark, sf), path)
    return tidy(N.flat_results(N.read_nested_results(spark, path)).drop("file"))


@query("results_first_success", q_eval.TUNE_SQL + tidy_sql("""SELECT model_key, optimization_metric, min_precision_constraint, tuning_samples
FROM t_res WHERE success ORDER BY model_key LIMIT 1""", ["min_precision_constraint"]))
def q_results_first_success(spark, sf):
    path = scratch(spark)
    N.write_nested_results(q_eval.tuned(spark, sf), path)
    first = N.first_successful(N.flat_results(N.read_nested_results(spark, path)))
    return tidy(first.select("model_key", "optimization_metric", "min_precision_constraint", "tuning_samples"))


COLL_SQL = "WITH c AS (SELECT vec_id, embedding, label FROM embeddings)"


def all_entries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("entry_id"), F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("text"), "embedding", "label",
                    F.lit(None).cast("string").alias("llm_response"))


@query("open_collection", COLL_SQL + """ SELECT 'semantic_cache' AS collection_name, count(*) AS total_embeddings,
  CAST(64 AS BIGINT) AS embedding_dimension, min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension
FROM c WHERE label <> 3 OR vec_id % 2 = 0""")
def q_open_collection(spark, sf):
    root = scratch(spark)
    coll = S.open_collection(spark, root, "semantic_cache", expected_dim=64)
    e = all_entries(spark, sf)
    coll.add(e, id_col="entry_id", stored_at="2024-01-01 00:00:00")
    coll.delete(e.where(F.col("label") == 3).select(F.col("entry_id").cast("string").alias("entry_id")),
                "2024-01-02 00:00:00")
    # opened again, it takes back half of what was deleted
    again = S.open_collection(spark, root, "semantic_cache", expected_dim=64)
    again.add(e.where((F.col("label") == 3) & (F.col("entry_id") % 2 == 0)), id_col="entry_id", stored_at="2024-01-03 00:00:00")
    return tidy(again.stats())


@query("clear_collection", COLL_SQL + """ SELECT CAST(0 AS BIGINT) AS after_clear, count(*) AS after_reload FROM c""")
def q_clear_collection(spark, sf):
    coll = S.open_collection(spark, scratch(spark), "semantic_cache", expected_dim=64)
    e = all_entries(spark, sf)
    coll.add(e, id_col="entry_id", stored_at="2024-01-01 00:00:00")
    coll.clear()
    n0 = coll.entries().count()
    coll.add(e, id_col="entry_id", stored_at="2024-01-01 00:00:00")
    return coll.entries().agg(F.lit(n0).cast("bigint").alias("after_clear"), F.count(F.lit(1)).alias("after_reload"))
