"""Store maintenance, cache serving extras and chat-cache entries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nearhit.functions.ids import make_entry_id
from nearhit.operators import cache as C
from nearhit.operators import store as S
from nearhit.operators import vector_join as J
from nearhit.operators.metrics import hit_predicate
from nearhit.plans import fixtures as X
from nearhit.plans.catalog import query, r6, tidy
from nearhit.operators.serve import cache_from_text
from nearhit.plans.q_replay import walk_sql
from nearhit.plans.q_text import EMB, sparse_sql
from nearhit.plans.q_vector import LOOKUP_CTES, LOOKUP_T, lookup
from nearhit.plans.sqlparts import tidy_sql
from nearhit.session import ensure_checkpoint_dir
from nearhit.sources.tables import table

STORED_AT = "2024-01-01 00:00:00"
MODEL = "minilm-l6"
COS = X.cos_sql


# ----------------------------------------------------------------- chat cache entries

def chat_cache(spark, sf):
    """User turns with the following assistant turn as the stored response."""
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", "text")
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("llm_response"))
    return u.join(a, ["conv_id", "turn"], "left").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))


CHAT_SQL = """chat AS (SELECT u.conv_id, u.turn, u.text, a.text AS llm_response, u.conv_id * 1000 + u.turn AS seq
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""
ID_SQL = f"md5(concat_ws(':', '{MODEL}', text, '{STORED_AT}', CAST(seq AS VARCHAR)))"


@query("make_entry_id", f"""WITH turns AS (SELECT conv_id, turn, text, conv_id * 1000 + turn AS seq FROM conversations)
SELECT conv_id, turn, {ID_SQL} AS entry_id FROM turns""")
def q_make_id(spark, sf):
    c = table(spark, sf, "conversations").withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    return c.select("conv_id", "turn", make_entry_id(F.lit(MODEL), "text", F.lit(STORED_AT).cast("timestamp"), "seq").alias("entry_id"))


TURNS_SQL = """turns AS (SELECT text, conv_id * 1000 + turn AS seq, CASE WHEN role = 'assistant' THEN role END AS llm_response
  FROM conversations WHERE text IS NOT NULL)"""
EMBED_DIM = 256


def turn_entries(spark, sf):
    """Every turn as an entry to add: its text embedded (a text without an n-gram is a zero vector)."""
    c = table(spark, sf, "conversations").where(F.col("text").isNotNull())
    rows = c.select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.col("role") == "assistant", F.col("role")).alias("llm_response"))
    zero = F.array_repeat(F.lit(0.0), EMBED_DIM)
    return EMB(rows).withColumn("embedding", F.coalesce("embedding", zero))


@query("add_entries", f"""WITH {TURNS_SQL},
{sparse_sql('turns', 'seq', 'text', 0, EMBED_DIM, 3, 'sv')},
cells AS (SELECT seq, count(*) AS nonzero, sum(CAST(CAST(weight AS FLOAT) AS DOUBLE) * (bucket + 1)) AS moment FROM sv GROUP BY seq)
SELECT {ID_SQL} AS entry_id, '{MODEL}' AS model_key, text, llm_response, seq, coalesce(nonzero, 0) AS nonzero,
  {r6('coalesce(moment, 0.0)')} AS moment FROM turns LEFT JOIN cells USING (seq)""")
def q_add_entries(spark, sf):
    coll = S.open_collection(spark, f"{ensure_checkpoint_dir(spark)}/add-{uuid.uuid4().hex}", expected_dim=EMBED_DIM)
    coll.add(turn_entries(spark, sf), model_key=MODEL, stored_at=STORED_AT, seq="seq")
    e = coll.entries()
    nonzero = F.size(F.filter("embedding", lambda x: x != 0))
    # the vector is compared by its cells and their first moment, rounded as float32 holds them
    moment = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return tidy(e.select("entry_id", "model_key", "text", "llm_response", "seq", nonzero.cast("bigint").alias("nonzero"), moment.alias("moment")))


# ----------------------------------------------------------------- store over the embeddings cache

TOUCH_SQL = LOOKUP_CTES + """, touches AS (SELECT nearest_id AS entry_id, query_id, seq FROM lookup WHERE nearest_id IS NOT NULL)"""


def filled_collection(spark, sf, touched=False, deleted=False):
    """A collection of the entries, touched by a lookup of all requests, with one class deleted and one of its ids added again."""
    coll = S.open_collection(spark, f"{ensure_checkpoint_dir(spark)}/coll-{uuid.uuid4().hex}", expected_dim=64)
    e = X.entries(spark, sf)
    coll.add(e, id_col="entry_id", stored_at=STORED_AT, seq="entry_id")
    if touched:
        # one touch a request: the touch log is appended second by second of the request order
        t = C.lookup_touches(lookup(spark, sf)).select(F.col("entry_id").cast("string").alias("entry_id"), "query_id", "was_hit")
        coll.touch(t, TOUCHED_AT, query_id="query_id", was_hit="was_hit")
    if deleted:
        coll.delete(e.where(F.col("label") == 3).select(F.col("entry_id").cast("string").alias("entry_id")), DELETED_AT)
        coll.add(e.where((F.col("label") == 3) & (F.col("entry_id") % 4 == 0)), id_col="entry_id", stored_at=READDED_AT, seq="entry_id")
    return coll


TOUCHED_AT, DELETED_AT, READDED_AT = "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-04 00:00:00"


@query("touch_entries", TOUCH_SQL + f"""
SELECT CAST(e.entry_id AS VARCHAR) AS entry_id, count(t.query_id) AS cache_hit_count,
  CASE WHEN count(t.query_id) > 0 THEN '{TOUCHED_AT}' ELSE '{STORED_AT}' END AS last_access
FROM entries e LEFT JOIN touches t USING (entry_id) GROUP BY e.entry_id""")
def q_touch(spark, sf):
    e = filled_collection(spark, sf, touched=True).entries()
    return e.select("entry_id", "cache_hit_count", F.date_format("last_access", "yyyy-MM-dd HH:mm:ss").alias("last_access"))


ALL_SQL = "entries_all AS (SELECT vec_id AS entry_id, embedding, label FROM embeddings)"


def all_entries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding", "label")


@query("delete_by_ids", "WITH " + ALL_SQL + " SELECT entry_id FROM entries_all WHERE label <> 3")
def q_delete(spark, sf):
    e = all_entries(spark, sf)
    return S.delete_by_ids(e, e.where(F.col("label") == 3).select("entry_id")).select("entry_id")


@query("get_by_ids", X.with_ctes(X.ENTRIES_SQL, X.REQUESTS_SQL) + """SELECT entry_id, text, llm_response FROM entries
WHERE entry_id IN (SELECT query_id - 1 FROM requests UNION ALL SELECT query_id + 1000000 FROM requests)""")
def q_get(spark, sf):
    r = X.requests(spark, sf)
    ids = r.select((F.col("query_id") - 1).alias("entry_id")).union(r.select((F.col("query_id") + 1000000).alias("entry_id")))
    return S.get_by_ids(X.entries(spark, sf), ids).select("entry_id", "text", "llm_response")


@query("collection_stats", "WITH " + ALL_SQL + """ SELECT 'semantic_cache' AS collection_name, count(*) AS total_embeddings,
  CAST(64 AS BIGINT) AS embedding_dimension, min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension FROM entries_all""")
def q_stats_coll(spark, sf):
    return tidy(S.collection_stats(all_entries(spark, sf), "semantic_cache", 64))


@query("compact", TOUCH_SQL + f""", live AS (SELECT * FROM entries WHERE label <> 3 OR entry_id % 4 = 0)
SELECT CAST(l.entry_id AS VARCHAR) AS entry_id, coalesce(t.n, 0) AS cache_hit_count,
  CASE WHEN l.label = 3 THEN '{READDED_AT}' WHEN t.n IS NOT NULL THEN '{TOUCHED_AT}' ELSE '{STORED_AT}' END AS last_access FROM live l
LEFT JOIN (SELECT entry_id, count(*) AS n FROM touches GROUP BY entry_id) t USING (entry_id)""")
def q_compact(spark, sf):
    e = filled_collection(spark, sf, touched=True, deleted=True).entries()
    return e.select("entry_id", "cache_hit_count", F.date_format("last_access", "yyyy-MM-dd HH:mm:ss").alias("last_access"))


# ----------------------------------------------------------------- cache serving extras

@query("hit_predicate", LOOKUP_CTES + f"""SELECT r.query_id, CAST(coalesce(nn.distance < {LOOKUP_T} AND e.llm_response IS NOT NULL, false) AS BIGINT) AS is_hit
FROM requests r LEFT JOIN nn USING (query_id) LEFT JOIN entries e ON e.entry_id = nn.entry_id WHERE NOT r."force" """)
def q_hit_pred(spark, sf):
    r = X.requests(spark, sf).where(~F.col("force"))
    nn = J.nearest_one(r, X.entries(spark, sf))
    j = r.select("query_id").join(nn, "query_id", "left").join(
        X.entries(spark, sf).select("entry_id", "llm_response"), "entry_id", "left")
    return tidy(j.select("query_id", F.coalesce(hit_predicate("distance", "llm_response", LOOKUP_T), F.lit(False)).alias("is_hit")))


STATS_SQL = f"""SELECT count(*) AS total_queries, count(*) FILTER (WHERE outcome = 'hit') AS cache_hits,
  count(*) FILTER (WHERE outcome = 'miss') AS cache_misses, count(*) FILTER (WHERE outcome IN ('miss', 'forced')) AS llm_calls,
  CASE WHEN count(*) > 0 THEN round(CAST(count(*) FILTER (WHERE outcome = 'hit') AS DOUBLE) / count(*) * 100, 2) ELSE 0.0 END AS hit_rate,
  (SELECT count(*) FROM entries) + count(*) FILTER (WHERE outcome IN ('miss', 'forced')) AS total_cached_entries,
  CAST({LOOKUP_T} AS DOUBLE) AS similarity_threshold FROM lookup"""


@query("cache_stats", LOOKUP_CTES + tidy_sql(STATS_SQL, ["hit_rate", "similarity_threshold"]))
def q_cache_stats(spark, sf):
    return tidy(C.cache_stats(lookup(spark, sf), X.entries(spark, sf), LOOKUP_T))


WHAT_IF = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]


@query("threshold_what_if", LOOKUP_CTES + tidy_sql(f"""SELECT t.threshold,
  count(*) FILTER (WHERE l.distance < t.threshold AND e.llm_response IS NOT NULL) AS cache_hits,
  (SELECT count(*) FROM lookup) AS total_queries,
  round(CAST(count(*) FILTER (WHERE l.distance < t.threshold AND e.llm_response IS NOT NULL) AS DOUBLE) / (SELECT count(*) FROM lookup) * 100, 2) AS hit_rate
FROM (VALUES {", ".join(f"({t})" for t in WHAT_IF)}) AS t(threshold) CROSS JOIN lookup l LEFT JOIN entries e ON e.entry_id = l.nearest_id
GROUP BY t.threshold""", ["threshold", "hit_rate"]))
def q_what_if(spark, sf):
    return tidy(C.threshold_what_if(lookup(spark, sf), X.entries(spark, sf), WHAT_IF))


@query("fill_misses", LOOKUP_CTES + """SELECT l.query_id, l.outcome, r.text, 'LLM called' AS response, CAST(NULL AS VARCHAR) AS error
FROM lookup l JOIN requests r USING (query_id) WHERE l.outcome IN ('miss', 'forced')""")
def q_fill(spark, sf):
    return C.fill_misses(lookup(spark, sf), X.requests(spark, sf))


SIM_T = 0.5


@query("seeded_simulation", X.with_ctes(X.ENTRIES_SQL, X.REQUESTS_SQL) + f"""SELECT
  count(*) FILTER (WHERE distance < {SIM_T}) AS hits,
  count(*) FILTER (WHERE NOT distance < {SIM_T}) AS misses,
  (SELECT count(*) FROM entries) AS total_embeddings
FROM (SELECT r.query_id, nn.distance, e.llm_response FROM requests r
  JOIN (SELECT query_id, entry_id, distance FROM (SELECT r.query_id, e.entry_id, 1 - {COS('r.embedding', 'e.embedding')} AS distance,
        row_number() OVER (PARTITION BY r.query_id ORDER BY 1 - {COS('r.embedding', 'e.embedding')}, e.entry_id) AS rn
        FROM requests r CROSS JOIN entries e) WHERE rn = 1) nn USING (query_id)
  JOIN entries e ON e.entry_id = nn.entry_id)""")
def q_seeded(spark, sf):
    e = X.entries(spark, sf)
    r = X.requests(spark, sf).drop("force")
    # the walkthrough counts a hit on the distance alone, whether or not a response is stored
    out = r.select("query_id").join(J.nearest_one(r, e), "query_id")
    st = S.collection_stats(e, "semantic_cache", 64).select("total_embeddings")
    return out.agg(F.count_if(F.col("distance") < SIM_T).alias("hits"),
                   F.count_if(F.col("distance") >= SIM_T).alias("misses")).crossJoin(st)


@query("simulation_hits", X.with_ctes(X.ENTRIES_SQL, X.REQUESTS_SQL) + tidy_sql(f"""SELECT n.query_id,
  CASE WHEN n.distance < {SIM_T} THEN 'hit' ELSE 'miss' END AS outcome, n.distance,
  CASE WHEN n.distance < {SIM_T} THEN e.entry_id END AS matched_id, CASE WHEN n.distance < {SIM_T} THEN e.text END AS matched_text,
  CASE WHEN n.distance < {SIM_T} THEN e.llm_response END AS response
FROM (SELECT query_id, arg_min(entry_id, (distance, entry_id)) AS entry_id, min(distance) AS distance
      FROM (SELECT r.query_id, e.entry_id, round(1 - {COS('r.embedding', 'e.embedding')}, 12) AS distance FROM requests r CROSS JOIN entries e)
      GROUP BY query_id) n JOIN entries e USING (entry_id)""", ["distance"]))
def q_simulation_hits(spark, sf):
    return tidy(C.simulate(X.requests(spark, sf), X.entries(spark, sf), SIM_T))


@query("cache_stats_by_user", LOOKUP_CTES + tidy_sql("""SELECT r.user_id, count(*) AS total_queries,
  count(*) FILTER (WHERE l.outcome = 'hit') AS cache_hits, count(*) FILTER (WHERE l.outcome = 'miss') AS cache_misses,
  count(*) FILTER (WHERE l.outcome IN ('miss', 'forced')) AS llm_calls,
  round(CAST(count(*) FILTER (WHERE l.outcome = 'hit') AS DOUBLE) / count(*) * 100, 2) AS hit_rate,
  """ + f"CAST({LOOKUP_T} AS DOUBLE)" + """ AS similarity_threshold
FROM lookup l JOIN requests r USING (query_id) GROUP BY r.user_id""", ["hit_rate", "similarity_threshold"],
    ints=["user_id"]))
def q_cache_stats_user(spark, sf):
    o = lookup(spark, sf).join(X.requests(spark, sf).select("query_id", "user_id"), "query_id")
    return tidy(C.cache_stats(o, X.entries(spark, sf), LOOKUP_T, by=["user_id"]))


def event_requests(spark, sf):
    """``events`` as batch requests: event -> vector ``event_id mod n``, with its user and day."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = emb.count()
    ev = table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("event_id").alias("seq"),
                                           "user_id", F.to_date("ts").alias("day"),
                                           F.pmod("event_id", F.lit(n)).alias("vec_id"))
    return ev.join(emb, "vec_id").drop("vec_id")


EVENTS_SQL = f"""ereq AS (SELECT e.event_id AS query_id, e.user_id, CAST(e.ts AS DATE) AS day, m.embedding
  FROM events e JOIN embeddings m ON m.vec_id = e.event_id % (SELECT count(*) FROM embeddings)),
ed AS (SELECT r.query_id, x.entry_id, 1 - {COS('r.embedding', 'x.embedding')} AS distance FROM ereq r CROSS JOIN entries x),
enn AS (SELECT query_id, entry_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS rn FROM ed) WHERE rn = 1),
elk AS (SELECT r.query_id, r.user_id, r.day,
  CASE WHEN n.distance < {LOOKUP_T} AND x.llm_response IS NOT NULL THEN 'hit' ELSE 'miss' END AS outcome
  FROM ereq r LEFT JOIN enn n USING (query_id) LEFT JOIN entries x ON x.entry_id = n.entry_id)"""


@query("cache_stats_rollup", X.with_ctes(X.ENTRIES_SQL, EVENTS_SQL) + tidy_sql("""SELECT user_id, CAST(day AS VARCHAR) AS day,
  count(*) AS total_queries, count(*) FILTER (WHERE outcome = 'hit') AS cache_hits,
  count(*) FILTER (WHERE outcome = 'miss') AS cache_misses, count(*) FILTER (WHERE outcome = 'miss') AS llm_calls,
  round(CAST(count(*) FILTER (WHERE outcome = 'hit') AS DOUBLE) / count(*) * 100, 2) AS hit_rate,
  """ + f"CAST({LOOKUP_T} AS DOUBLE)" + """ AS similarity_threshold
FROM elk GROUP BY ROLLUP (user_id, day)""", ["hit_rate", "similarity_threshold"], ints=["user_id"]))
def q_cache_stats_rollup(spark, sf):
    req = event_requests(spark, sf)
    out = C.cache_lookup(req.drop("user_id", "day"), X.entries(spark, sf), LOOKUP_T)
    o = out.join(req.select("query_id", "user_id", F.col("day").cast("string").alias("day")), "query_id")
    return tidy(C.cache_stats(o, X.entries(spark, sf), LOOKUP_T, by=["user_id", "day"], rollup=True))


# ----------------------------------------------------------------- the cache from text

TEXT_T = 0.6
SAID_SQL = f"""said AS (SELECT seq AS query_id, min(seq) OVER (PARTITION BY text) AS first_seq, seq, text, llm_response FROM chat WHERE text IS NOT NULL),
told AS (SELECT s.query_id, s.seq, s.text, o.llm_response AS answer, false AS "force" FROM said s JOIN said o ON o.seq = s.first_seq),
{sparse_sql('told', 'seq', 'text', 0, EMBED_DIM, 3, 'tv')},
vecs AS (SELECT seq, map_from_entries(list((bucket, weight))) AS m FROM tv GROUP BY seq),
asked AS (SELECT t.*, list_transform(range({EMBED_DIM}), lambda b: coalesce(v.m[b], 0.0)) AS embedding FROM told t JOIN vecs v USING (seq))"""


@query("cache_from_text", "WITH RECURSIVE " + CHAT_SQL + ",\n" + SAID_SQL + ",\n"
       + walk_sql(TEXT_T, "asked", seeds=None, fail="answer IS NULL") + f"""
SELECT t.query_id, t.seq, coalesce(r.outcome, 'miss') AS outcome, coalesce(r.inserted, 0) AS inserted, r.matched_id, r.distance,
  CASE WHEN r.outcome = 'hit' THEN o.answer ELSE t.answer END AS response
FROM told t LEFT JOIN replayed r USING (query_id) LEFT JOIN told o ON CAST(o.query_id AS VARCHAR) = r.matched_id""")
def q_from_text(spark, sf):
    ch = chat_cache(spark, sf).where(F.col("text").isNotNull())
    # the provider answers a text as the assistant did when it was first asked
    first = ch.groupBy("text").agg(F.min_by(F.struct("llm_response"), "seq").alias("a")).select("text", F.col("a.llm_response").alias("response"))
    out = cache_from_text(ch.select(F.col("seq").alias("query_id"), "seq", "text"), EMB, TEXT_T, first)
    return tidy(out)
