"""Store walkthrough: add three, get two, delete one, two remain; clear; batch rules of adding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhit.operators.cache import cache_lookup, cache_stats, simulate
from nearhit.operators.store import open_collection
from nearhit.functions.vector import similarity_to_distance


def _vecs(spark, texts, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(t, [float(x) for x in rng.normal(size=dim)], f"Response {i + 1}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "text string, embedding array<double>, llm_response string")


def test_walkthrough(spark, scratch):
    coll = open_collection(spark, scratch, "semantic_cache", expected_dim=8)
    added = coll.add(_vecs(spark, ["Hello world", "Machine learning", "Data science"]),
                     stored_at="2024-01-01 00:00:00")
    ids = sorted(r[0] for r in added.select("entry_id").collect())
    assert len(ids) == 3 and coll.stats().first()["total_embeddings"] == 3
    got = coll.get(spark.createDataFrame([(ids[0],), (ids[1],), ("missing",)], "entry_id string"))
    assert got.count() == 2
    coll.delete(spark.createDataFrame([(ids[0],)], "entry_id string"), "2024-01-02 00:00:00")
    assert coll.entries().count() == 2
    coll.touch(spark.createDataFrame([(ids[1],), (ids[1],)], "entry_id string"), "2024-01-03 00:00:00")
    assert coll.entries().where(F.col("entry_id") == ids[1]).first()["cache_hit_count"] == 2
    coll.clear()
    assert coll.entries().count() == 0
    # re-adding after clear works and ids are reproducible
    again = coll.add(_vecs(spark, ["Hello world", "Machine learning", "Data science"]),
                     stored_at="2024-01-01 00:00:00")
    assert sorted(r[0] for r in again.select("entry_id").collect()) == ids


def _ids(df):
    return sorted(r[0] for r in df.select("entry_id").collect())


def test_an_id_can_be_added_again_after_a_delete(spark, scratch):
    coll = open_collection(spark, scratch, expected_dim=8)
    rows = _vecs(spark, ["a", "b"]).withColumn("id", F.col("text"))
    coll.add(rows, id_col="id", stored_at="2024-01-01 00:00:00")
    coll.delete(spark.createDataFrame([("a",)], "entry_id string"), "2024-01-02 00:00:00")
    assert _ids(coll.entries()) == ["b"]
    coll.add(rows, id_col="id", stored_at="2024-01-03 00:00:00")
    assert _ids(coll.entries()) == ["a", "b"] and coll.entries().count() == 2


def test_add_without_a_time_returns_all_ids(spark, scratch):
    coll = open_collection(spark, scratch)
    added = coll.add(_vecs(spark, ["a", "b"]))
    assert _ids(added) == _ids(coll.entries()) and added.count() == 2


def test_equal_texts_of_a_batch_get_ids_of_their_own(spark, scratch):
    coll = open_collection(spark, scratch)
    added = coll.add(_vecs(spark, ["same", "same", "same"]), stored_at="2024-01-01 00:00:00")
    assert len(set(_ids(added))) == 3 == coll.entries().count()


def test_batch_rules(spark, scratch):
    coll = open_collection(spark, scratch, expected_dim=2)
    df = spark.createDataFrame([("a", [1.0, 0.0], None, {"llm_response": "given", "note": "n"}, "1"), ("b", [0.0, 1.0], "r", None, "2")],
                               "text string, embedding array<double>, llm_response string, meta map<string,string>, id string")
    coll.add(df, id_col="id", extra="meta", stored_at="2024-01-01 00:00:00")
    got = {r.entry_id: (r.llm_response, dict(r.extra)) for r in coll.entries().collect()}
    assert got == {"1": ("given", {"note": "n"}), "2": ("r", {})}
    for bad in (df.union(df), df.withColumn("text", F.lit(None).cast("string")), df.withColumn("embedding", F.array(F.lit(1.0)))):
        with pytest.raises(Exception):
            coll.add(bad.withColumn("id", F.concat(F.lit("x"), "id")), id_col="id")
    assert coll.entries().count() == 2


def test_a_broken_store_is_an_error_not_an_empty_one(spark, scratch):
    import os
    os.makedirs(f"{scratch}/semantic_cache/entries")
    with open(f"{scratch}/semantic_cache/entries/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        open_collection(spark, scratch).entries().count()


def test_provider_answers_a_text_once_or_fails(spark):
    from nearhit.operators.cache import ask_provider, fill_misses
    outcomes = spark.createDataFrame([(1, "miss"), (2, "miss"), (3, "hit")], "query_id long, outcome string")
    req = spark.createDataFrame([(1, "q"), (2, "z"), (3, "q")], "query_id long, text string")
    twice = spark.createDataFrame([("q", "r"), ("q", "r")], "text string, response string")
    got = {r.query_id: (r.response, r.error) for r in fill_misses(outcomes, req, twice).collect()}
    assert got == {1: ("r", None), 2: (None, "no response")}
    with pytest.raises(Exception):
        fill_misses(outcomes, req, spark.createDataFrame([("q", "r"), ("q", "s")], "text string, response string")).collect()

    def answer(texts):
        return [None if t == "z" else ValueError("down") if t == "x" else t.upper() for t in texts]
    asked = ask_provider(spark.createDataFrame([("q",), ("q",), ("z",), ("x",), (None,)], "text string"), answer).collect()
    assert sorted((r.text, r.response, r.error) for r in asked) == [("q", "Q", None), ("x", None, "down"), ("z", None, "no response")]


def test_thresholds_and_keys_are_checked(spark):
    from nearhit.operators.registry import scope_keys
    req = spark.createDataFrame([(1, 1, [1.0])], "query_id long, seq long, embedding array<double>")
    store = spark.createDataFrame([], "entry_id long, text string, embedding array<double>, llm_response string")
    for t in (-0.1, 2.1):
        with pytest.raises(ValueError):
            cache_lookup(req, store, t)
    with pytest.raises(ValueError):
        scope_keys(["no-such-model"])


def test_empty_store_all_miss_and_stats(spark):
    req = spark.createDataFrame([(1, 1, [1.0, 0.0], False), (2, 2, [0.0, 1.0], True)],
                                "query_id long, seq long, embedding array<double>, force boolean")
    store = spark.createDataFrame([], "entry_id long, text string, embedding array<double>, llm_response string")
    out = cache_lookup(req, store, 0.3)
    assert sorted(r["outcome"] for r in out.collect()) == ["forced", "miss"]
    s = cache_stats(out, store, 0.3).first()
    assert (s["total_queries"], s["cache_hits"], s["cache_misses"], s["llm_calls"], s["hit_rate"]) == (2, 0, 1, 2, 0.0)


def test_similarity_to_distance_examples():
    for s, d in [(0.78, 0.22), (0.77, 0.23), (0.74, 0.26)]:
        assert abs(similarity_to_distance(s) - d) < 1e-12
    for bad in (-0.1, 1.1):
        try:
            similarity_to_distance(bad)
            raise AssertionError("expected ValueError")
        except ValueError:
            pass


def test_threshold_what_if_strict_boundaries(spark):
    from nearhit.operators.cache import threshold_what_if
    outs = spark.createDataFrame(
        [(1, 1, "miss", 10, 0.5), (2, 2, "hit", 11, 0.3), (3, 3, "miss", 12, 0.3), (4, 4, "forced", None, None)],
        "query_id long, seq long, outcome string, nearest_id long, distance double")
    store = spark.createDataFrame([(10, "r"), (11, "r"), (12, None)], "entry_id long, llm_response string")
    got = {r["threshold"]: (r["cache_hits"], r["total_queries"], r["hit_rate"])
           for r in threshold_what_if(outs, store, [0.3, 0.5, 0.6]).collect()}
    # distance == threshold is not a hit; entry 12 has no response, so never a hit
    assert got == {0.3: (0, 4, 0.0), 0.5: (1, 4, 25.0), 0.6: (2, 4, 50.0)}


def test_simulation_lists_every_request(spark):
    ddl = "entry_id long, text string, embedding array<float>, llm_response string"
    entries = spark.createDataFrame([(1, "one", [1.0, 0.0], "r1"), (2, "two", [0.0, 1.0], None), (3, "again", [2.0, 0.0], "r3")], ddl)
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 3.0]), (12, [1.0, 1.0]), (13, None), (14, [0.0, 0.0])],
                                  "query_id long, embedding array<float>")
    got = [tuple(r) for r in simulate(asked, entries, 0.2).orderBy("query_id").collect()]
    far = round(1 - 0.5 ** 0.5, 12)
    assert got == [(10, "hit", 0.0, 1, "one", "r1"), (11, "hit", 0.0, 2, "two", None), (12, "miss", pytest.approx(far), None, None, None),
                   (13, "miss", None, None, None, None), (14, "miss", None, None, None, None)]
    none = simulate(asked, entries.where("false"), 0.2).collect()
    assert len(none) == 5 and all(r.outcome == "miss" and r.distance is None for r in none)
    with pytest.raises(ValueError):
        simulate(asked, entries, 2.5)
