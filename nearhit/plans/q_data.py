"""Dataset preparation queries over ``question_pairs`` (whole documents)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nearhit.functions.ids import hash32_sql, hash_unit_sql
from nearhit.functions.text import WS
from nearhit.operators import datasets as D
from nearhit.plans import fixtures as X
from nearhit.plans.catalog import query, tidy
from nearhit.plans.sqlparts import tidy_sql

SEED = 42
BASE = X.with_ctes(X.QUESTION_PAIRS_SQL)


def qp(spark, sf):
    return X.question_pairs(spark, sf)


def strip_sql(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


KEEP_SQL = (f"question1 IS NOT NULL AND question2 IS NOT NULL AND TRY_CAST(is_duplicate AS DOUBLE) IN (0, 1) "
            f"AND {strip_sql('question1')} <> '' AND {strip_sql('question2')} <> ''")
RANK_SQL = f"row_number() OVER (ORDER BY {hash32_sql(SEED, 'id')}, id)"


RAW = X.with_ctes(X.RAW_PAIRS_SQL)


@query("clean_pairs", RAW + f"""SELECT id, qid1, qid2, CAST(TRY_CAST(is_duplicate AS DOUBLE) AS BIGINT) AS is_duplicate
FROM raw_pairs WHERE {KEEP_SQL}""")
def q_clean(spark, sf):
    return tidy(D.clean_pairs(X.raw_pairs(spark, sf)).select("id", "qid1", "qid2", "is_duplicate"))


@query("clean_report", RAW + tidy_sql(f"""SELECT count(*) AS original_rows, count(*) FILTER (WHERE {KEEP_SQL}) AS valid_rows,
  count(*) - count(*) FILTER (WHERE {KEEP_SQL}) AS removed_rows,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE {KEEP_SQL}) AS DOUBLE) / count(*) * 100 ELSE 0.0 END AS valid_pct
FROM raw_pairs""", ["valid_pct"]))
def q_clean_report(spark, sf):
    return tidy(D.clean_report(X.raw_pairs(spark, sf)))


HEAD_N = 1000


@query("head_n", BASE + f"SELECT id, qid1, qid2, CAST(is_duplicate AS BIGINT) AS is_duplicate FROM question_pairs ORDER BY id LIMIT {HEAD_N}")
def q_head(spark, sf):
    return tidy(D.head_n(qp(spark, sf), HEAD_N).select("id", "qid1", "qid2", "is_duplicate"))


SAMPLE_N = 300


@query("sample_n", BASE + f"""SELECT id, qid1, qid2, CAST(is_duplicate AS BIGINT) AS is_duplicate FROM (
  SELECT *, {RANK_SQL} AS _r FROM question_pairs) WHERE _r <= {SAMPLE_N}""")
def q_sample(spark, sf):
    return tidy(D.sample_n(qp(spark, sf), SAMPLE_N, SEED).select("id", "qid1", "qid2", "is_duplicate"))


@query("subset", BASE + "SELECT id, qid1, qid2 FROM question_pairs WHERE question1 LIKE '%the%' AND qid2 > 100")
def q_subset(spark, sf):
    p = qp(spark, sf)
    return D.subset(p, F.col("question1").contains("the") & (F.col("qid2") > 100)).select("id", "qid1", "qid2")


K = 5


@query("k_folds", BASE + f"SELECT id, {hash32_sql(SEED, 'id')} % {K} AS fold FROM question_pairs")
def q_folds(spark, sf):
    return tidy(D.k_folds(qp(spark, sf), K, SEED).select("id", "fold"))


@query("k_folds_exact", BASE + f"""SELECT id, CAST(floor(({RANK_SQL} - 1) * {K} / (SELECT count(*) FROM question_pairs)) AS BIGINT) AS fold
FROM question_pairs""")
def q_folds_exact(spark, sf):
    return tidy(D.k_folds(qp(spark, sf), K, SEED, exact=True).select("id", "fold"))


@query("class_balance", BASE + tidy_sql(f"""SELECT count(*) AS rows, avg(CAST(is_duplicate AS DOUBLE)) AS duplicate_share,
  avg(CAST(is_duplicate AS DOUBLE)) < 0.1 OR avg(CAST(is_duplicate AS DOUBLE)) > 0.9 AS imbalanced
FROM question_pairs WHERE {KEEP_SQL}""", ["duplicate_share"], bools=["imbalanced"]))
def q_balance(spark, sf):
    return tidy(D.class_balance(D.clean_pairs(qp(spark, sf))))


U = hash_unit_sql(SEED, "id")
SPLIT_SQL = f"CASE WHEN {U} < 0.5 THEN 'train' WHEN {U} < 0.8 THEN 'val' ELSE 'test' END"


@query("split_three_way", BASE + f"SELECT id, {SPLIT_SQL} AS split FROM question_pairs")
def q_split(spark, sf):
    return D.split_three_way(qp(spark, sf), seed=SEED).select("id", "split")


@query("split_three_way_exact", BASE + f"""SELECT id, CASE WHEN r <= n_test THEN 'test' WHEN r <= n_test + n_val THEN 'val' ELSE 'train' END AS split
FROM (SELECT id, {RANK_SQL} AS r FROM question_pairs),
     (SELECT CAST(ceil(n * 0.2) AS BIGINT) AS n_test, CAST(ceil((n - ceil(n * 0.2)) * (0.3 / 0.8)) AS BIGINT) AS n_val
      FROM (SELECT count(*) AS n FROM question_pairs))""")
def q_split_exact(spark, sf):
    return D.split_three_way_exact(qp(spark, sf), seed=SEED).select("id", "split")


@query("split_balance", BASE + tidy_sql(f"""SELECT coalesce(split, 'Original') AS split, count(*) AS rows,
  count(*) FILTER (WHERE is_duplicate = 1) AS duplicates,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE is_duplicate = 1) AS DOUBLE) / count(*) * 100 ELSE 0.0 END AS duplicate_pct,
  count(*) FILTER (WHERE is_duplicate = 0) AS non_duplicates,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE is_duplicate = 0) AS DOUBLE) / count(*) * 100 ELSE 0.0 END AS non_duplicate_pct
FROM (SELECT *, {SPLIT_SQL} AS split FROM question_pairs WHERE {KEEP_SQL}) GROUP BY ROLLUP (split)""",
    ["duplicate_pct", "non_duplicate_pct"]))
def q_split_balance(spark, sf):
    return tidy(D.split_balance(D.split_three_way(D.clean_pairs(qp(spark, sf)), seed=SEED)))


@query("k_folds_contiguous", BASE + f"""SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) * {K}
  / (SELECT count(*) FROM question_pairs)) AS BIGINT) AS fold FROM question_pairs""")
def q_folds_contiguous(spark, sf):
    return tidy(D.k_folds_contiguous(qp(spark, sf), K).select("id", "fold"))
