"""Text, embedding and paraphrase queries over ``documents``, ``benchmark``
and ``question_pairs``; all texts are processed whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearhit.functions.ids import hash32_sql
from nearhit.functions.text import NUMBERING, WS, normalize_text, normalize_text_sql, strip_numbering
from nearhit.operators import embed as E
from nearhit.operators import paraphrase as P
from nearhit.operators import sparse_join as SJ
from nearhit.operators import weighted as W
from nearhit.plans import fixtures as X
from nearhit.plans.catalog import query, tidy
from nearhit.plans.sqlparts import tidy_sql
from nearhit.sources.tables import table

EMB = E.HashedEmbedder(seed=0, dim=256, n=3)
MODELS = {"hash3-256": E.HashedEmbedder(0, 256, 3), "hash3-512": E.HashedEmbedder(1, 512, 3),
          "hash1-256": E.HashedEmbedder(2, 256, 1)}


def strip_sql(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query("normalize_text", f"SELECT doc_id, {normalize_text_sql('text')} AS norm FROM documents")
def q_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_text("text").alias("norm"))


# statements = non-blank stripped lines of the benchmark texts
STATEMENTS_SQL = f"""st AS (SELECT item_id, line_no, {strip_sql('line')} AS statement FROM (
  SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE {strip_sql('line')} <> '')"""


def statements(spark, sf):
    return P.read_statement_lines(table(spark, sf, "benchmark"), "text", "item_id")


@query("read_statements", "WITH " + STATEMENTS_SQL + " SELECT item_id, line_no, statement FROM st")
def q_statements(spark, sf):
    return tidy(statements(spark, sf).drop("nth"))


@query("strip_numbering", f"""SELECT conv_id, turn, line_no, regexp_replace(line, '{NUMBERING}', '', 'g') AS stripped FROM (
  SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM conversations)""")
def q_strip_numbering(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return tidy(lines.select("conv_id", "turn", "line_no", strip_numbering("line").alias("stripped")))


def sparse_sql(src: str, id_col: str, text_col: str, seed: int, dim: int, n: int, name: str) -> str:
    """CTEs ``{name}`` = (id, bucket, weight) of the hashed n-gram embedder."""
    norm = normalize_text_sql(text_col)
    if n > 1:
        grams = f"list_transform(range(0, len(w) - {n - 1}), lambda i: array_to_string(w[i + 1:i + {n}], ' '))"
    else:
        grams = "w"
    return f"""{name}_w AS (SELECT {id_col} AS _id, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END AS w
  FROM (SELECT {id_col}, {norm} AS t FROM {src}) AS _n),
{name}_g AS (SELECT _id, unnest({grams}) AS gram FROM {name}_w),
{name}_c AS (SELECT _id, {hash32_sql(seed, 'gram')} % {dim} AS bucket, CAST(count(*) AS DOUBLE) AS c FROM {name}_g GROUP BY ALL),
{name} AS (SELECT _id AS {id_col}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY _id)) AS weight FROM {name}_c)"""


@query("embed_texts", "WITH " + sparse_sql("documents", "doc_id", "text", 0, 256, 3, "sv")
       + tidy_sql("SELECT doc_id, bucket, weight FROM sv", ["weight"]))
def q_embed_texts(spark, sf):
    docs = table(spark, sf, "documents")
    return tidy(EMB.sparse(docs, "doc_id", "text"))


WORDS = E.HashedEmbedder(seed=3, dim=4096, n=1)


@query("embed_weighted", "WITH " + sparse_sql("documents", "doc_id", "text", 3, 4096, 1, "sv") + """,
df AS (SELECT bucket, ln((1 + (SELECT count(DISTINCT doc_id) FROM sv)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM sv GROUP BY bucket),
wt AS (SELECT doc_id, bucket, weight * idf AS w FROM sv JOIN df USING (bucket)) """
       + tidy_sql("SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wt", ["weight"]))
def q_embed_weighted(spark, sf):
    docs = table(spark, sf, "documents")
    return tidy(W.fit_idf(docs, WORDS).sparse(docs, "doc_id", "text"))


@query("embed_dense")
def q_embed_dense(spark, sf):
    """Each text's length within the 32 strongest directions of the weighted corpus; tested against numpy, not in SQL."""
    docs = table(spark, sf, "documents")
    idf = W.fit_idf(docs, WORDS)
    return tidy(W.embed_dense(docs.select("doc_id", "text"), idf, W.fit_subspace(docs, idf, 32)).select("doc_id", F.size("embedding").alias("dim"), "kept"), 3)


@query("embedding_dimension", "SELECT count(*) AS vectors, min(len(embedding)) AS min_dim, "
       "max(len(embedding)) AS max_dim FROM embeddings")
def q_dim(spark, sf):
    e = table(spark, sf, "embeddings")
    return tidy(e.agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("min_dim"),
                      F.max(F.size("embedding")).alias("max_dim")))


def distinct_sql(seed, dim, n, name):
    return f"""{name}_t AS (SELECT DISTINCT md5(text) AS tid, text FROM (
    SELECT question1 AS text FROM question_pairs UNION ALL SELECT question2 FROM question_pairs) WHERE text IS NOT NULL),
{sparse_sql(name + '_t', 'tid', 'text', seed, dim, n, name)},
{name}_s AS (SELECT p.id, sum(a.weight * b.weight) AS similarity
  FROM question_pairs p JOIN {name} a ON a.tid = md5(p.question1) JOIN {name} b ON b.tid = md5(p.question2) AND b.bucket = a.bucket
  GROUP BY p.id),
{name}_ids AS (SELECT DISTINCT tid FROM {name}),
{name}_r AS (SELECT p.id, CASE WHEN md5(p.question1) IN (SELECT tid FROM {name}_ids)
                               AND md5(p.question2) IN (SELECT tid FROM {name}_ids)
                          THEN coalesce(s.similarity, 0.0) END AS similarity
  FROM question_pairs p LEFT JOIN {name}_s s USING (id))"""


@query("embed_distinct", X.with_ctes(X.QUESTION_PAIRS_SQL, distinct_sql(0, 256, 3, "d0"))
       + tidy_sql("SELECT id, similarity FROM d0_r", ["similarity"]))
def q_embed_distinct(spark, sf):
    return tidy(E.embed_distinct(X.question_pairs(spark, sf), EMB))


def scored_text_sql():
    ctes = [X.QUESTION_PAIRS_SQL]
    sels = []
    for i, (key, m) in enumerate(MODELS.items()):
        ctes.append(distinct_sql(m.seed, m.dim, m.n, f"m{i}"))
        sels.append(f"SELECT '{key}' AS model_key, id, similarity FROM m{i}_r")
    ctes.append("text_scored AS (SELECT s.model_key, s.id, s.similarity, q.is_duplicate FROM ("
                + " UNION ALL ".join(sels) + ") s JOIN question_pairs q USING (id))")
    return X.with_ctes(*ctes)


def text_scored(spark, sf):
    return E.score_pairs(X.question_pairs(spark, sf), MODELS)


@query("score_pairs", scored_text_sql() + tidy_sql("SELECT * FROM text_scored", ["similarity"], ints=["is_duplicate"]))
def q_score_pairs(spark, sf):
    return tidy(text_scored(spark, sf))


# ----------------------------------------------------------------- 2.E sparse similarity join

WIDE = E.HashedEmbedder(seed=3, dim=1 << 18, n=3)
NEAR = 0.8
SPARSE_JOIN_SQL = "WITH " + sparse_sql("documents", "doc_id", "text", WIDE.seed, WIDE.dim, WIDE.n, "sv") + f""",
sig AS (SELECT doc_id, string_agg(bucket || ':' || weight, ' ' ORDER BY bucket) AS h FROM sv GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM sig),
dots AS (SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.weight * b.weight), 9) AS similarity
  FROM sv a JOIN sv b ON a.bucket = b.bucket AND a.doc_id <> b.doc_id GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= {NEAR})"""


def sparse_join(spark, sf):
    return SJ.SparseJoin(WIDE.vectors(table(spark, sf, "documents"), "doc_id", "text"), NEAR, "doc_id")


@query("similarity_join_sparse", SPARSE_JOIN_SQL + tidy_sql(""" SELECT a, b, similarity FROM dots
  JOIN cls x ON x.doc_id = a AND x.class_id = a JOIN cls y ON y.doc_id = b AND y.class_id = b WHERE a < b""", ["similarity"]))
def q_sparse_join(spark, sf):
    return tidy(sparse_join(spark, sf).pairs())


@query("similarity_join_links", SPARSE_JOIN_SQL + """ SELECT cls.doc_id, class_id, count(a) AS links
FROM cls LEFT JOIN dots ON a = cls.doc_id GROUP BY ALL""")
def q_sparse_links(spark, sf):
    join = sparse_join(spark, sf)
    return tidy(join.links(join.pairs()).withColumnRenamed("id", "doc_id"))


# ----------------------------------------------------------------- 2.M paraphrases

BATCH_SQL = STATEMENTS_SQL + f""",
sb AS (SELECT *, position // {P.BATCH_SIZE} AS batch, position % {P.BATCH_SIZE} AS slot FROM (
  SELECT *, row_number() OVER (ORDER BY item_id, line_no) - 1 AS position FROM st)),
sizes AS (SELECT batch, count(*) AS n_statements FROM sb GROUP BY batch)"""


def batches(spark, sf):
    return P.statement_batches(statements(spark, sf), "item_id")


@query("statement_batches", "WITH " + BATCH_SQL + " SELECT item_id, line_no, position, batch, slot FROM sb")
def q_batches(spark, sf):
    return tidy(batches(spark, sf).select("item_id", "line_no", "position", "batch", "slot"))


def _sqlstr(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("batch_prompts", "WITH " + BATCH_SQL + f"""
SELECT batch, count(*) AS n_statements,
  {_sqlstr(P.PROMPT_HEAD)} || string_agg(CAST(slot + 1 AS VARCHAR) || '. ' || statement, chr(10) ORDER BY slot) || chr(10)
  || {_sqlstr(P.PROMPT_TAIL)} AS prompt
FROM sb GROUP BY batch""")
def q_prompts(spark, sf):
    return tidy(P.batch_prompts(batches(spark, sf)))


NUM_SQL = NUMBERING
VARIANTS_SQL = BATCH_SQL + f""",
resp AS (SELECT conv_id, turn, conv_id % (SELECT count(*) FROM sizes) AS batch, text AS response
  FROM conversations WHERE role = 'assistant'),
cl AS (SELECT z.batch, r.conv_id, r.turn, z.n_statements,
  list_transform(list_filter(list_transform(string_split({strip_sql("coalesce(r.response, '')")}, chr(10)), lambda x: {strip_sql('x')}),
                             lambda x: x <> ''), lambda x: regexp_replace(x, '{NUM_SQL}', '', 'g')) AS v
  FROM sizes z LEFT JOIN resp r USING (batch)),
vars AS (SELECT batch, conv_id, turn, generate_subscripts(p, 1) - 1 AS slot, unnest(p) AS variant FROM (
  SELECT batch, conv_id, turn, (v || list_transform(range(n_statements), lambda i: ''))[1:n_statements] AS p FROM cl))"""
ANSWER = ("conv_id", "turn")


def answers(spark, sf, n_batches):
    """Every assistant turn as an answer, dealt to the ``n_batches`` batches by conversation."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.select(F.pmod("conv_id", F.lit(n_batches)).alias("batch"), *ANSWER, F.col("text").alias("response"))


def variants(spark, sf):
    b = batches(spark, sf)
    sizes = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n_statements"))
    return b, P.parse_variants(answers(spark, sf, max(1, sizes.count())), sizes, ANSWER)


@query("parse_variants", "WITH " + VARIANTS_SQL + " SELECT batch, conv_id, turn, slot, variant FROM vars")
def q_variants(spark, sf):
    return tidy(variants(spark, sf)[1])


PAIRS_SQL = VARIANTS_SQL + """,
pp AS (SELECT sb.position, v.conv_id, v.turn, sb.statement, v.variant AS semantically_same_statement
  FROM sb JOIN vars v ON v.batch = sb.batch AND v.slot = sb.slot WHERE v.variant <> '')"""


@query("paraphrase_pairs", "WITH " + PAIRS_SQL + " SELECT * FROM pp")
def q_para_pairs(spark, sf):
    b, v = variants(spark, sf)
    return tidy(P.paraphrase_pairs(b, v, ANSWER))


@query("paraphrase_yield", "WITH " + VARIANTS_SQL + tidy_sql("""SELECT s.statements, s.pairs,
  CASE WHEN s.statements > 0 THEN CAST(s.pairs AS DOUBLE) / s.statements * 100 ELSE 0.0 END AS yield_pct
  FROM (SELECT count(*) AS statements, count(*) FILTER (variant <> '') AS pairs FROM vars) s""", ["yield_pct"]))
def q_para_yield(spark, sf):
    return tidy(P.paraphrase_yield(variants(spark, sf)[1]))
