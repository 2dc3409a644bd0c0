"""Views derived from the driver tables, in Spark and as DuckDB SQL text.

Each Spark builder has a SQL twin with the same columns so the oracle can
recompute every registered query from the same parquet tables.

* ``entries``  : even ``vec_id`` of ``embeddings`` form the stored cache
* ``requests`` : odd ``vec_id`` are the incoming queries, in ``vec_id`` order
* ``vector_pairs`` : ``a.vec_id < b.vec_id <= a.vec_id + 20`` pairs, label
  equality as ``is_duplicate`` (a band join, expressed as an equi-join on
  exploded offsets so it never becomes a nested loop)
* ``model_pairs`` : the same pairs scored by several "models" = prefixes of
  the vector (cosine is scale invariant, so no re-normalisation needed)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.functions.vector import cosine_similarity_batched as cosine_similarity
from nearhit.functions.vector import matrices
from nearhit.sources.tables import table

PAIR_SPAN = 20
# Fixed test "models": registry key -> number of leading vector components used.
MODEL_DIMS = [("minilm-l3", 8), ("minilm-l6", 16), ("msmarco-minilm", 24),
              ("mpnet-base", 32), ("labse", 48), ("bge-large", 64)]
# Sweep grid for vector_pairs / model_pairs: similarities of the shortest
# prefix model reach about 0.95, so the grid runs -0.50 .. 0.99.
VECTOR_GRID = [i / 100.0 for i in range(-50, 100)]
# The reference grid: 0.50, 0.51, ..., 0.99.
REFERENCE_GRID = [i / 100.0 for i in range(50, 100)]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 0)
    return e.select(
        F.col("vec_id").alias("entry_id"),
        F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding"),
        F.col("label"),
        F.when(F.col("vec_id") % 20 != 0,
               F.concat(F.lit("resp-"), F.col("vec_id").cast("string"))).alias("llm_response"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 1)
    return r.select(
        F.col("vec_id").alias("query_id"),
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding"),
        (F.col("vec_id") % 50 == 49).alias("force"),
        (F.col("vec_id") % 7).alias("user_id"),
    )


def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one ordered request log (``seq = vec_id``)."""
    r = table(spark, sf_dir, "embeddings")
    return r.select(
        F.col("vec_id").alias("query_id"), F.col("vec_id").alias("seq"),
        F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding"), (F.col("vec_id") % 50 == 49).alias("force"),
        (F.col("vec_id") % 7).alias("user_id"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    a = emb.select(F.col("vec_id").alias("vec_a"), F.col("embedding").alias("emb_a"),
                   F.col("label").alias("label_a"),
                   F.explode(F.sequence(F.lit(1), F.lit(PAIR_SPAN))).alias("off"))
    a = a.withColumn("vec_b", F.col("vec_a") + F.col("off"))
    b = emb.select(F.col("vec_id").alias("vec_b"), F.col("embedding").alias("emb_b"),
                   F.col("label").alias("label_b"))
    p = a.join(b, "vec_b")
    p = p.select(
        (F.col("vec_a") * 32 + F.col("off")).alias("pair_id"), "vec_a", "vec_b",
        (F.col("label_a") == F.col("label_b")).cast("int").alias("is_duplicate"),
        "emb_a", "emb_b",
    )
    p = p.withColumn("similarity", cosine_similarity("emb_a", "emb_b"))
    return p if with_vectors else p.drop("emb_a", "emb_b")


def model_dims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_DIMS, "model_key string, dims int")


def _prefix_cosines(dims: list[int]):
    """Cosine of the first ``d`` components for every ``d`` in ``dims`` from
    one pass of cumulative sums: one Arrow round trip for all models instead
    of one per model."""
    i = np.asarray(dims) - 1

    def f(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full((len(a), len(i)), np.nan)
        for rows, A, B in matrices(a, b):
            ab, aa, bb = (np.cumsum(x, axis=1)[:, i] for x in (A * B, A * A, B * B))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[rows] = np.where(aa * bb > 0, ab / np.sqrt(aa * bb), np.nan)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * len(i)), pa.array(out.reshape(-1)))
    return F.arrow_udf(f, "array<double>")


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored_pairs`` long table: (model_key, pair_id, similarity, is_duplicate)."""
    p = vector_pairs(spark, sf_dir, with_vectors=True).drop("similarity")
    keys = F.array(*[F.lit(k) for k, _ in MODEL_DIMS])
    sims = _prefix_cosines([d for _, d in MODEL_DIMS])("emb_a", "emb_b")
    z = p.select("pair_id", "vec_a", "vec_b", "is_duplicate", F.arrays_zip(keys.alias("k"), sims.alias("s")).alias("_z"))
    z = z.select("pair_id", "vec_a", "vec_b", "is_duplicate", F.explode_outer("_z").alias("_m"))
    return z.select(F.col("_m.k").alias("model_key"), "pair_id", "vec_a", "vec_b",
                    F.col("_m.s").alias("similarity"), "is_duplicate")


# ---------------------------------------------------------------- SQL twins

def cos_sql(a: str, b: str) -> str:
    a, b = f"({a})::DOUBLE[]", f"({b})::DOUBLE[]"
    return (f"(list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) "
            f"* list_inner_product({b}, {b})))")


ENTRIES_SQL = """entries AS (
  SELECT vec_id AS entry_id, 'query ' || CAST(vec_id AS VARCHAR) AS text, embedding, label,
         CASE WHEN vec_id % 20 <> 0 THEN 'resp-' || CAST(vec_id AS VARCHAR) END AS llm_response
  FROM embeddings WHERE vec_id % 2 = 0)"""

REQUESTS_SQL = """requests AS (
  SELECT vec_id AS query_id, vec_id AS seq, 'query ' || CAST(vec_id AS VARCHAR) AS text, embedding,
         vec_id % 50 = 49 AS "force", vec_id % 7 AS user_id
  FROM embeddings WHERE vec_id % 2 = 1)"""

VECTOR_PAIRS_RAW_SQL = f"""vector_pairs_raw AS (
  SELECT a.vec_id * 32 + (b.vec_id - a.vec_id) AS pair_id, a.vec_id AS vec_a, b.vec_id AS vec_b,
         CAST(a.label = b.label AS INTEGER) AS is_duplicate, a.embedding AS emb_a, b.embedding AS emb_b
  FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + {PAIR_SPAN})"""

VECTOR_PAIRS_SQL = VECTOR_PAIRS_RAW_SQL + f""",
vector_pairs AS (
  SELECT pair_id, vec_a, vec_b, is_duplicate, {cos_sql('emb_a', 'emb_b')} AS similarity
  FROM vector_pairs_raw)"""


def model_dims_sql() -> str:
    vals = ", ".join(f"('{k}', {d})" for k, d in MODEL_DIMS)
    return f"SELECT * FROM (VALUES {vals}) AS m(model_key, dims)"


MODEL_PAIRS_SQL = VECTOR_PAIRS_RAW_SQL + f""",
model_dims AS ({model_dims_sql()}),
model_pairs AS (
  SELECT m.model_key, p.pair_id, p.vec_a, p.vec_b,
         {cos_sql('p.emb_a[1:m.dims]', 'p.emb_b[1:m.dims]')} AS similarity, p.is_duplicate
  FROM vector_pairs_raw p CROSS JOIN model_dims m)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-pair table (T1) from whole documents: each document paired
    with the next id; the label is ``quality + toxic`` of the first document
    (null without a label row, 2 when both are set) so cleaning has work."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = d.select(F.col("doc_id").alias("qid1"), F.col("text").alias("question1"),
                 (F.col("doc_id") + 1).alias("qid2"))
    b = d.select(F.col("doc_id").alias("qid2"), F.col("text").alias("question2"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid1"),
                                                (F.col("quality") + F.col("toxic")).alias("is_duplicate"))
    return (a.join(b, "qid2").join(lab, "qid1", "left")
             .select(F.col("qid1").alias("id"), "qid1", "qid2", "question1", "question2", "is_duplicate"))


QUESTION_PAIRS_SQL = """question_pairs AS (
  SELECT a.doc_id AS id, a.doc_id AS qid1, b.doc_id AS qid2, a.text AS question1, b.text AS question2,
         l.quality + l.toxic AS is_duplicate
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN labels l ON l.doc_id = a.doc_id)"""


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_pairs`` as read from text: labels such as ``1.0``, ``0.7`` and ``yes``, blank and missing questions."""
    q = question_pairs(spark, sf_dir)
    lab = F.col("is_duplicate").cast("string")
    lab = (F.when(F.col("id") % 7 == 0, F.concat(lab, F.lit(".0"))).when(F.col("id") % 11 == 0, F.lit("0.7"))
            .when(F.col("id") % 13 == 0, F.lit("yes")).when(F.col("id") % 17 == 0, F.lit("1.9")).otherwise(lab))
    q1 = F.when(F.col("id") % 19 == 0, F.lit(" \t")).when(F.col("id") % 23 != 0, F.col("question1"))
    return q.withColumn("is_duplicate", lab).withColumn("question1", q1)


RAW_PAIRS_SQL = QUESTION_PAIRS_SQL + """,
raw_pairs AS (SELECT id, qid1, qid2,
    CASE WHEN id % 19 = 0 THEN ' ' || chr(9) WHEN id % 23 <> 0 THEN question1 END AS question1, question2,
    CASE WHEN id % 7 = 0 THEN CAST(is_duplicate AS VARCHAR) || '.0' WHEN id % 11 = 0 THEN '0.7'
         WHEN id % 13 = 0 THEN 'yes' WHEN id % 17 = 0 THEN '1.9' ELSE CAST(is_duplicate AS VARCHAR) END AS is_duplicate
  FROM question_pairs)"""
