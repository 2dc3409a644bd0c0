"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.llm import alignment, langid, lmscore, mixing, packing, pii, quality, simhash, spelling, substrings, suffix, topk, toxicity
from nearhit.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the registered query and the pipeline. A real run takes it from a secret store.
PII_KEY = "demo-key-1"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key=PII_KEY, count="n_replaced")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs, labels, use=_remainder(3) != 1)
    return toxicity.score(docs, grammar).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, use=_remainder(5) != 0)
    return langid.predict(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken(*mixing.mix(docs, size=mixing.n_words(F.col("text"))))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), _remainder(7) == 2)


QUERIES = {f.__name__: f for f in (op1_pseudonyms, op2_quality, op3_substrings, op4_toxicity, op5_language, op6_suffix, op7_simhash, op8_pack,
                                   op9_mix_sources, op10_top_k, op11_align, op12_spelling, op13_lm_score)}

ORACLE = {
    "op2_quality": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text,
             list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM d),
p AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM p) WHERE n > 1),
c AS (SELECT rid, sum(least(8, i - coalesce(prev, i - 8))) AS n
      FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM t) GROUP BY rid),
f AS (SELECT w.doc_id, w.source, len(lines) AS n_lines, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.rid = c.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS symbols_failed,
             n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines AS lines_failed, word_chars < 3 * n_words OR word_chars > 10 * n_words AS length_failed FROM f),
u AS (SELECT source, rule, failed FROM b, LATERAL (VALUES ('base', base_failed), ('symbols', symbols_failed), ('lines', lines_failed),
                                                          ('length', length_failed)) x(rule, failed)),
h AS (SELECT source, rule, count(*) AS docs, count(*) FILTER (failed) AS failed FROM u GROUP BY source, rule),
m AS (SELECT rule, sum(failed) / sum(docs) AS mu, count(*) AS hosts, sum(docs) AS docs FROM h GROUP BY rule),
v AS (SELECT rule, mu, sum(h.docs * (h.failed / h.docs - mu) ** 2) / any_value(m.docs) - mu * (1 - mu) * any_value(hosts) / any_value(m.docs) AS between
      FROM h JOIN m USING (rule) GROUP BY rule, mu),
s AS (SELECT rule, mu, CASE WHEN between > 0 THEN least(1e6, greatest(1.0, mu * (1 - mu) / between - 1)) ELSE 1e6 END AS weight FROM v),
q AS (SELECT source, rule, (failed + mu * weight) / (docs + weight) AS rate FROM h JOIN s USING (rule)),
r AS (SELECT source, max(rate) FILTER (rule <> 'length') > 0.8 AS host_failed, max(rate) FILTER (rule = 'symbols') > 0.5 AS symbols_ok,
             max(rate) FILTER (rule = 'lines') > 0.5 AS lines_ok, max(rate) FILTER (rule = 'length') > 0.5 AS length_ok FROM q GROUP BY source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbols_failed, lines_failed, length_failed,
       NOT base_failed AND NOT host_failed AND (NOT symbols_failed OR symbols_ok) AND (NOT lines_failed OR lines_ok)
       AND (NOT length_failed OR length_ok) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
""",
    "op3_substrings": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
           FROM documents),
p AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY gram) AS n FROM p) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS j FROM t, range(35) r(k)),
w AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM w ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
""",
    "op10_top_k": """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
""",
    "op12_spelling": """
WITH RECURSIVE crc AS (
SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT doc_id, run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
      WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT))),
                                                 lambda c, d: xor(c >> 8, t[1 + (xor(c, d) & 255)]))) AS h FROM b, crc),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM g a JOIN g b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
      UNION SELECT g.word, w.word FROM g JOIN w ON g.head || g.tail = w.word
      UNION SELECT w.word, g.word FROM g JOIN w ON g.head || g.tail = w.word),
f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS near_n FROM p JOIN w ON w.word = p.b GROUP BY a),
o AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN f ON f.word = w.word),
u AS (SELECT word, word AS root FROM o UNION ALL SELECT u.word, o.form FROM u JOIN o ON o.word = u.root WHERE o.form IS NOT NULL)
SELECT o.word, o.form, u.root, o.n, CAST(o.n_near AS BIGINT) AS n_near, o.form_n
FROM o JOIN u ON u.word = o.word JOIN o AS e ON e.word = u.root AND e.form IS NULL
""",
}
