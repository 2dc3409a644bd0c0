"""Cache serving against a frozen store: lookup, fill, stats, what-if.

Semantics kept from the reference:

* only the single nearest entry counts; a hit needs ``distance < threshold``
  (strict) **and** a stored response, otherwise it is a miss (S2, S3);
* the nearest entry is touched on every unforced lookup, hit or miss (S4);
* forced requests skip the lookup and always call the provider (S6);
* ``hit_rate = round(hits / total * 100, 2)`` with forced requests in the
  denominator, 0.0 on no requests (S8).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhit.operators.vector_join import nearest_one

MOCK_RESPONSE = "LLM called"


def check_threshold(threshold: float) -> float:
    """A cosine-distance threshold lies in 0..2."""
    if not 0.0 <= float(threshold) <= 2.0:
        raise ValueError(f"a cosine distance threshold of {threshold} is outside 0..2")
    return float(threshold)


def provider_table(provider: DataFrame) -> DataFrame:
    """``(text, response, error)`` with one row a text. Two different answers to one text fail the job."""
    p = provider if "error" in provider.columns else provider.withColumn("error", F.lit(None).cast("string"))
    one = p.groupBy("text").agg(F.min(F.struct("response", "error")).alias("a"), F.max(F.struct("response", "error")).alias("z"))
    clash = F.raise_error(F.concat(F.lit("more than one answer to: "), F.substring("text", 1, 80)))
    return one.select("text", F.when(F.col("a") != F.col("z"), clash).otherwise(F.col("a.response")).alias("response"),
                      F.col("a.error").alias("error"))


def ask_provider(texts: DataFrame, answer, batch_size: int = 32) -> DataFrame:
    """``(text, response, error)``: each distinct text is asked once.

    ``answer`` maps a list of texts to a list of responses, None or an
    exception object for a failed call. It runs on executors."""
    distinct = texts.select("text").where(F.col("text").isNotNull()).distinct()

    def run(batches):
        for b in batches:
            asked = b.column(0).to_pylist()
            for i in range(0, len(asked), batch_size):
                part = asked[i:i + batch_size]
                got = list(answer(part))
                failed = [str(g) if isinstance(g, Exception) else "no response" if g is None else None for g in got]
                yield pa.record_batch([pa.array(part, pa.string()),
                                       pa.array([None if f else g for g, f in zip(got, failed)], pa.string()),
                                       pa.array(failed, pa.string())], names=["text", "response", "error"])

    return distinct.mapInArrow(run, "text string, response string, error string")


def cache_lookup(requests: DataFrame, store: DataFrame, threshold: float = 0.3, *,
                 vec: str = "embedding", key: list[str] | None = None) -> DataFrame:
    """Outcome per request against a frozen store.

    ``requests``: ``query_id, seq, embedding[, force]``; ``store``:
    ``entry_id, text, embedding, llm_response``. Returns ``query_id, seq,
    outcome, nearest_id, distance, matched_id, matched_text, response``.
    An empty store gives all misses (left join).
    """
    threshold = check_threshold(threshold)
    has_force = "force" in requests.columns
    force = F.coalesce(F.col("force"), F.lit(False)) if has_force else F.lit(False)
    req = requests.withColumn("_forced", force)
    unforced = req.where(~F.col("_forced"))
    nn = nearest_one(unforced, store, query_id="query_id", entry_id="entry_id",
                     query_vec=vec, entry_vec=vec, key=key)
    payload = store.select(F.col("entry_id").alias("nearest_id"), F.col("text").alias("_text"),
                           F.col("llm_response").alias("_resp"))
    out = (req.select("query_id", "seq", "_forced")
              .join(nn.withColumnRenamed("entry_id", "nearest_id"), "query_id", "left")
              .join(payload, "nearest_id", "left"))
    hit = (F.col("distance") < F.lit(threshold)) & F.col("_resp").isNotNull()
    outcome = F.when(F.col("_forced"), F.lit("forced")).when(hit, F.lit("hit")).otherwise(F.lit("miss"))
    return out.select(
        "query_id", "seq", outcome.alias("outcome"),
        F.when(~F.col("_forced"), F.col("nearest_id")).alias("nearest_id"),
        F.when(~F.col("_forced"), F.col("distance")).alias("distance"),
        F.when(hit & ~F.col("_forced"), F.col("nearest_id")).alias("matched_id"),
        F.when(hit & ~F.col("_forced"), F.col("_text")).alias("matched_text"),
        F.when(hit & ~F.col("_forced"), F.col("_resp")).alias("response"),
    )


def lookup_touches(outcomes: DataFrame) -> DataFrame:
    """Touch log rows for a lookup: the nearest entry of every unforced request."""
    return outcomes.where(F.col("nearest_id").isNotNull()).select(
        F.col("nearest_id").alias("entry_id"), "query_id", "seq",
        (F.col("outcome") == "hit").alias("was_hit"))


def simulate(requests: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """Each request with its nearest entry: ``query_id, outcome, distance, matched_id, matched_text, response``.

    The simulation counts a hit on the distance alone (strictly below the
    threshold), whether or not a response is stored. ``matched_*`` and ``response`` are set on hits;
    without any entry, or with a vector that matches nothing, a request is a miss without a distance."""
    hit = F.coalesce(F.col("distance") < check_threshold(threshold), F.lit(False))
    near = nearest_one(requests.select("query_id", "embedding"), entries.select("entry_id", "embedding"))
    texts = entries.select("entry_id", F.col("text").alias("_text"), "llm_response")
    out = requests.select("query_id").join(near.select("query_id", "entry_id", "distance"), "query_id", "left")
    return out.join(texts, "entry_id", "left").select(
        "query_id", F.when(hit, "hit").otherwise("miss").alias("outcome"), "distance",
        *[F.when(hit, F.col(c)).alias(n) for c, n in (("entry_id", "matched_id"), ("_text", "matched_text"), ("llm_response", "response"))])


def fill_misses(outcomes: DataFrame, requests: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """Attach a response to every miss/forced request.

    ``provider`` is a table ``(text, response[, error])`` keyed by request
    text (the batch form of an LLM call), or a function from a list of texts
    to a list of responses (``ask_provider``); without one the mock provider
    answers ``"LLM called"``. Failed calls carry ``error`` and no response.
    """
    need = outcomes.where(F.col("outcome").isin("miss", "forced")).select("query_id", "outcome")
    need = need.join(requests.select("query_id", "text"), "query_id")
    if provider is None:
        filled = need.withColumn("response", F.lit(MOCK_RESPONSE)).withColumn("error", F.lit(None).cast("string"))
    else:
        prov = ask_provider(need, provider) if callable(provider) else provider_table(provider)
        filled = need.join(prov, "text", "left")
        filled = filled.withColumn("error", F.when(F.col("response").isNull() & F.col("error").isNull(),
                                                   F.lit("no response")).otherwise(F.col("error")))
    return filled.select("query_id", "outcome", "text", "response", "error")


def cache_stats(outcomes: DataFrame, store: DataFrame, threshold: float,
                fills: DataFrame | None = None, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """total, hits, misses, llm_calls, hit_rate, total_cached_entries, threshold.

    Without ``fills`` every miss/forced call is assumed to succeed. With
    ``fills`` an error is still a miss (unless forced) but no LLM call and no
    insert (S7). ``by`` gives per-group stats (e.g. per user or day) and then
    entries are not reported; ``rollup`` adds the subtotal rows (null keys).
    """
    o = outcomes
    if fills is not None:
        o = o.join(fills.select("query_id", F.col("error").isNotNull().alias("_err")), "query_id", "left")
    else:
        o = o.withColumn("_err", F.lit(False))
    err = F.coalesce(F.col("_err"), F.lit(False))
    called = F.col("outcome").isin("miss", "forced") & ~err
    aggs = [F.count(F.lit(1)).alias("total_queries"),
            F.count_if(F.col("outcome") == "hit").alias("cache_hits"),
            F.count_if(F.col("outcome") == "miss").alias("cache_misses"),
            F.count_if(called).alias("llm_calls")]
    if by and rollup:
        s = o.rollup(*by).agg(*aggs)
    elif by:
        s = o.groupBy(*by).agg(*aggs)
    else:
        s = o.agg(*aggs).crossJoin(store.agg(F.count(F.lit(1)).alias("_stored")))
    s = s.withColumn("hit_rate", F.when(F.col("total_queries") > 0,
                                        F.round(F.col("cache_hits") / F.col("total_queries") * 100, 2))
                     .otherwise(F.lit(0.0)))
    if not by:
        s = s.withColumn("total_cached_entries", F.col("_stored") + F.col("llm_calls")).drop("_stored")
    return s.withColumn("similarity_threshold", F.lit(float(threshold)))


def threshold_what_if(outcomes: DataFrame, store: DataFrame, thresholds: list[float]) -> DataFrame:
    """Hits and hit rate for each candidate threshold, from one nearest-distance pass.

    Each request falls in the bucket "number of thresholds <= its distance";
    a hit at threshold ``t_j`` means ``distance < t_j``, so the hit count at
    ``t_j`` is the number of rows in buckets ``<= j``: one aggregate plus a
    cumulative sum over at most ``len(thresholds)+1`` rows. No cross join with
    the request table.
    """
    ts = sorted(float(t) for t in thresholds)
    spark = outcomes.sparkSession
    resp = store.select(F.col("entry_id").alias("nearest_id"), F.col("llm_response").isNotNull().alias("_has"))
    o = outcomes.join(resp, "nearest_id", "left")
    bucket = sum((F.col("distance") >= F.lit(t)).cast("int") for t in ts)
    eligible = F.col("distance").isNotNull() & F.coalesce(F.col("_has"), F.lit(False))
    counts = (o.withColumn("_b", F.when(eligible, bucket))
               .groupBy("_b").agg(F.count(F.lit(1)).alias("_n")))
    total = o.agg(F.count(F.lit(1)).alias("total_queries"))
    grid = spark.createDataFrame([(j, t) for j, t in enumerate(ts)], "_j int, threshold double")
    # hits(t_j) = rows with bucket <= j: join each grid row to its buckets (<= |grid|+1 rows each side)
    hits = (grid.join(F.broadcast(counts.where(F.col("_b").isNotNull())), F.col("_b") <= F.col("_j"), "left")
                .groupBy("_j", "threshold").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("cache_hits")))
    return (hits.crossJoin(total)
                .select("threshold", "cache_hits", "total_queries",
                        F.when(F.col("total_queries") > 0,
                               F.round(F.col("cache_hits") / F.col("total_queries") * 100, 2))
                        .otherwise(F.lit(0.0)).alias("hit_rate")))
