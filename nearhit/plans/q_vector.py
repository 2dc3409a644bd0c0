"""Vector functions, vector joins and cache serving over the ``embeddings`` table."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from nearhit.functions import vector as V
from nearhit.functions.ids import hash32_sql
from nearhit.operators import cache as C
from nearhit.operators import ivfpq as IVF
from nearhit.operators import vector_join as J
from nearhit.plans import fixtures as X
from nearhit.plans.catalog import query, r6, tidy
from nearhit.session import ensure_checkpoint_dir
from nearhit.sources.tables import table

LOOKUP_T = 0.65
COS = X.cos_sql

NN_SQL = f"""d AS (
  SELECT r.query_id, e.entry_id, 1 - {COS('r.embedding', 'e.embedding')} AS distance
  FROM requests r CROSS JOIN entries e WHERE NOT r."force"),
nn AS (SELECT query_id, entry_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS rn FROM d) WHERE rn = 1),
lookup AS (
  SELECT r.query_id, r.seq,
    CASE WHEN r."force" THEN 'forced'
         WHEN nn.distance < {LOOKUP_T} AND e.llm_response IS NOT NULL THEN 'hit' ELSE 'miss' END AS outcome,
    nn.entry_id AS nearest_id, nn.distance,
    CASE WHEN nn.distance < {LOOKUP_T} AND e.llm_response IS NOT NULL THEN nn.entry_id END AS matched_id,
    CASE WHEN nn.distance < {LOOKUP_T} AND e.llm_response IS NOT NULL THEN e.text END AS matched_text,
    CASE WHEN nn.distance < {LOOKUP_T} AND e.llm_response IS NOT NULL THEN e.llm_response END AS response
  FROM requests r LEFT JOIN nn ON nn.query_id = r.query_id LEFT JOIN entries e ON e.entry_id = nn.entry_id)"""

LOOKUP_CTES = X.with_ctes(X.ENTRIES_SQL, X.REQUESTS_SQL, NN_SQL)


def lookup(spark, sf):
    return C.cache_lookup(X.requests(spark, sf), X.entries(spark, sf), LOOKUP_T)


@query("cache_lookup", LOOKUP_CTES + f"""
SELECT query_id, seq, outcome, nearest_id, {r6('distance')} AS distance, matched_id, matched_text, response
FROM lookup""")
def q_cache_lookup(spark, sf):
    return tidy(lookup(spark, sf))


# ----------------------------------------------------------------- 2.B vector functions

@query("cosine_similarity", X.with_ctes(X.VECTOR_PAIRS_SQL)
       + f"SELECT pair_id, vec_a, vec_b, {r6('similarity')} AS similarity, CAST(is_duplicate AS BIGINT) AS is_duplicate FROM vector_pairs")
def q_cosine(spark, sf):
    return tidy(X.vector_pairs(spark, sf))


@query("l2_normalize", f"""SELECT vec_id, pos, {r6('component')} AS component FROM (
  SELECT vec_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS component FROM (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
    FROM embeddings))""")
def q_l2(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("pos", "component"))
    return tidy(e)


@query("check_dimension", f"SELECT vec_id, dim FROM (SELECT vec_id, CASE WHEN vec_id % 97 = 5 THEN len(embedding) - 1 ELSE len(embedding) END AS dim FROM embeddings) WHERE dim <> 64")
def q_check_dim(spark, sf):
    # every 97th vector loses its last component
    e = table(spark, sf, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 97 == 5, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding")))
    # report form (the failing form raises inside the task on the first bad row)
    return tidy(e.where(V.dimension_mismatch("embedding", 64)).select("vec_id", F.size("embedding").alias("dim")))


@query("similarity_to_distance", X.with_ctes(X.VECTOR_PAIRS_SQL) + f"""SELECT pair_id,
  CASE WHEN similarity BETWEEN 0 AND 1 THEN {r6('1 - similarity')} END AS distance,
  CAST(similarity NOT BETWEEN 0 AND 1 AS BIGINT) AS out_of_range FROM vector_pairs""")
def q_sim_to_dist(spark, sf):
    p = X.vector_pairs(spark, sf).withColumn("out_of_range", ~F.col("similarity").between(0, 1))
    return tidy(p.select("pair_id", F.when(~F.col("out_of_range"), V.similarity_to_distance("similarity")).alias("distance"), "out_of_range"))


# ----------------------------------------------------------------- 2.E vector joins

K = 5
KNN_SQL = X.with_ctes(X.ENTRIES_SQL, X.REQUESTS_SQL) + f"""SELECT query_id, entry_id, {r6('distance')} AS distance, rank FROM (
  SELECT r.query_id, e.entry_id, 1 - {COS('r.embedding', 'e.embedding')} AS distance,
    row_number() OVER (PARTITION BY r.query_id ORDER BY 1 - {COS('r.embedding', 'e.embedding')}, e.entry_id) AS rank
  FROM requests r CROSS JOIN entries e) WHERE rank <= {K}"""


@query("knn", KNN_SQL)
def q_knn(spark, sf):
    return tidy(J.knn(X.requests(spark, sf), X.entries(spark, sf), k=K))


@query("nearest_one", LOOKUP_CTES.replace('WHERE NOT r."force"', "") + f"SELECT query_id, entry_id, {r6('distance')} AS distance FROM nn")
def q_nearest(spark, sf):
    return tidy(J.nearest_one(X.requests(spark, sf), X.entries(spark, sf)))


JOIN_T = 0.7


@query("similarity_join", f"""SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, {r6('1 - ' + COS('a.embedding', 'b.embedding'))} AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE 1 - {COS('a.embedding', 'b.embedding')} < {JOIN_T}""")
def q_sim_join(spark, sf):
    e = table(spark, sf, "embeddings")
    return tidy(J.similarity_join(e, max_distance=JOIN_T, query_id="vec_id"))


@query("similarity_matrix", f"""SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, {r6(COS('a.embedding', 'b.embedding'))} AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def q_sim_matrix(spark, sf):
    e = table(spark, sf, "embeddings")
    return tidy(J.similarity_matrix(e, id_col="vec_id", upper=True))


# ----------------------------------------------------------------- approximate kNN

# half as many lists as entries (at most 1,024), three in ten of them probed: these vectors have no clusters, see README
MOST_LISTS, PROBE_SHARE, SUB, CODES, RERANK, ROUNDS, IVF_SEED = 1024, 0.3, 16, 64, 60, 3, 7


def _approx(spark, sf):
    entries = X.entries(spark, sf)
    lists = max(1, min(MOST_LISTS, entries.count() // 2))
    path = f"{ensure_checkpoint_dir(spark)}/ivf-{uuid.uuid4().hex}"
    return IVF.knn_ivf(X.requests(spark, sf), entries, path, K, dim=64, lists=lists, probes=math.ceil(PROBE_SHARE * lists), rerank=RERANK,
                       sub=SUB, codes=CODES, seed=IVF_SEED)


def _approx_sql() -> str:
    """The index in SQL: sampled rows, three rounds of k-means, codes, probes, looked-up scores and exact rerank."""
    unit = "list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])))"
    width = 64 // SUB
    ctes = [X.ENTRIES_SQL, X.REQUESTS_SQL, f"sizes AS (SELECT greatest(1, least({MOST_LISTS}, count(*) // 2)) AS lists FROM entries)",
            f"u AS (SELECT entry_id, {unit.format(v='embedding')} AS v, row_number() OVER (ORDER BY {hash32_sql(IVF_SEED, 'entry_id')}, entry_id) AS nth FROM entries)",
            f"q AS (SELECT query_id, {unit.format(v='embedding')} AS v FROM requests)",
            "c0 AS (SELECT nth - 1 AS l, v AS c FROM u, sizes WHERE nth <= lists)"]
    for r in range(ROUNDS):
        ctes += [f"a{r} AS (SELECT entry_id, arg_min(l, (-list_inner_product(v, c), l)) AS l FROM u, c{r} GROUP BY entry_id)",
                 f"s{r} AS (SELECT l, list(x ORDER BY i) AS c FROM (SELECT l, i, sum(x) AS x FROM (SELECT l, unnest(v) AS x, unnest(range(64)) AS i FROM u JOIN a{r} USING (entry_id)) GROUP BY l, i) GROUP BY l)",
                 f"c{r + 1} AS (SELECT c{r}.l, CASE WHEN s{r}.c IS NULL THEN c{r}.c ELSE {unit.format(v=f's{r}.c')} END AS c FROM c{r} LEFT JOIN s{r} USING (l))"]
    ctes += [f"placed AS (SELECT entry_id, arg_min(l, (-list_inner_product(v, c), l)) AS l FROM u, c{ROUNDS} GROUP BY entry_id)",
             f"probed AS (SELECT query_id, l FROM (SELECT query_id, l, row_number() OVER (PARTITION BY query_id ORDER BY -list_inner_product(v, c), l) AS r FROM q, c{ROUNDS}), sizes WHERE r <= ceil({PROBE_SHARE} * lists))",
             f"book AS (SELECT s, nth - 1 AS code, v[s * {width} + 1:s * {width} + {width}] AS b FROM u, range({SUB}) t(s) WHERE nth <= {CODES})",
             f"coded AS (SELECT entry_id, s, arg_min(b, (list_distance(v[s * {width} + 1:s * {width} + {width}], b), code)) AS b FROM u, book GROUP BY entry_id, s)",
             "spelled AS (SELECT entry_id, flatten(list(b ORDER BY s)) AS w FROM coded GROUP BY entry_id)",
             f"near AS (SELECT query_id, entry_id FROM (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY -list_inner_product(v, w), entry_id) AS r "
             f"FROM probed JOIN placed USING (l) JOIN spelled USING (entry_id) JOIN q USING (query_id)) WHERE r <= {RERANK})"]
    dist = f"round(1 - {COS('r.embedding', 'e.embedding')}, 12)"
    return X.with_ctes(*ctes, f"""approx AS (SELECT query_id, entry_id, distance, rank FROM (
  SELECT query_id, entry_id, {dist} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {dist}, entry_id) AS rank
  FROM near JOIN requests r USING (query_id) JOIN entries e USING (entry_id)) WHERE rank <= {K})""")


APPROX_SQL = _approx_sql()


@query("knn_approx", APPROX_SQL + f"SELECT query_id, entry_id, {r6('distance')} AS distance, rank FROM approx")
def q_knn_approx(spark, sf):
    return tidy(_approx(spark, sf))


@query("knn_approx_recall", APPROX_SQL + f""", exact AS ({KNN_SQL[KNN_SQL.index("SELECT query_id, entry_id, "):]})
SELECT count(*) AS exact_pairs, count(a.entry_id) AS found_pairs, {r6("count(a.entry_id) / count(*)")} AS recall
FROM exact x LEFT JOIN approx a ON a.query_id = x.query_id AND a.entry_id = x.entry_id""")
def q_knn_recall(spark, sf):
    from nearhit.operators.lsh import recall_at_k
    exact = J.knn(X.requests(spark, sf), X.entries(spark, sf), k=K)
    return tidy(recall_at_k(_approx(spark, sf), exact))
