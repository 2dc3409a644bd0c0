"""Inverted file with product codes: recall on the real neighbours, work against the exact search, splitting and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhit.operators import ivfpq
from nearhit.operators.lsh import recall_at_k
from nearhit.operators.vector_join import knn
from nearhit.plans import fixtures as X
from nearhit.plans import q_vector
from nearhit.plans.catalog import QUERIES

from conftest import SF_MID, SF_SMALL


@pytest.mark.parametrize("sf", [SF_MID, "/root/testdata/sf0.1"])
def test_registered_query_finds_the_real_neighbours(spark, sf):
    exact = knn(X.requests(spark, sf), X.entries(spark, sf), k=q_vector.K)
    told = recall_at_k(QUERIES["knn_approx"](spark, sf), exact).first()
    print(sf, "recall", told["recall"])
    assert told["recall"] >= 0.9


@pytest.mark.parametrize("sf", [SF_MID, "/root/testdata/sf0.1"])
def test_fewer_than_half_of_the_pairs_are_looked_up(spark, sf, scratch):
    entries, requests = X.entries(spark, sf), X.requests(spark, sf)
    lists = entries.count() // 2
    model = ivfpq.fit(entries, dim=64, lists=lists)
    ivfpq.build(entries, model, f"{scratch}/index")
    index = spark.read.parquet(f"{scratch}/index")
    assert index.count() == entries.count() and index.select("id").distinct().count() == index.count()
    size = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    v = ivfpq.unit_rows(requests.select("embedding").toPandas()["embedding"], 64)
    near = model.nearest_lists(v, math.ceil(q_vector.PROBE_SHARE * lists))
    share = sum(size.get(int(c), 0) for c in near.ravel()) / (len(v) * entries.count())
    print(sf, "looked up", round(share, 3), "of all pairs; compared exactly", q_vector.RERANK / entries.count())
    assert share + q_vector.RERANK / entries.count() < 0.6 and share < 0.35


def test_split_lists_and_queries_change_nothing(spark, scratch, monkeypatch):
    entries, requests = X.entries(spark, SF_SMALL), X.requests(spark, SF_SMALL)
    model = ivfpq.fit(entries, dim=64, lists=3)
    ivfpq.build(entries, model, f"{scratch}/index")

    def found():
        return sorted(tuple(r) for r in ivfpq.search(requests, entries, model, f"{scratch}/index", probes=2, rerank=10_000).collect())
    whole = found()
    monkeypatch.setattr(ivfpq, "LIST_ROWS", 7)
    monkeypatch.setattr(ivfpq, "LIST_QUERIES", 11)
    assert found() == whole and len(whole) == 5 * requests.count()


def test_all_lists_probed_is_the_exact_search(spark, scratch):
    entries, requests = X.entries(spark, SF_SMALL), X.requests(spark, SF_SMALL)
    got = ivfpq.knn_ivf(requests, entries, f"{scratch}/index", dim=64, lists=9, probes=9, rerank=10_000)
    want = knn(requests, entries, k=5)
    keys = ["query_id", "entry_id", "rank"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))


def test_clustered_vectors_need_few_probes(spark, scratch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    entries = df.where("id % 2 = 0").withColumnRenamed("id", "entry_id")
    requests = df.where("id % 2 = 1").withColumnRenamed("id", "query_id")
    got = ivfpq.knn_ivf(requests, entries, f"{scratch}/index", dim=16, lists=40, probes=4, sub=8, rerank=50)
    assert recall_at_k(got, knn(requests, entries, k=5)).first()["recall"] > 0.9


def test_bad_vectors_and_empty_tables(spark, scratch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0])]
    entries = spark.createDataFrame(rows, "entry_id long, embedding array<double>")
    requests = entries.withColumnRenamed("entry_id", "query_id")
    got = ivfpq.knn_ivf(requests, entries, f"{scratch}/one", dim=2, lists=4, probes=4, sub=1)
    assert sorted((r["query_id"], r["entry_id"], r["rank"]) for r in got.collect()) == [(1, 1, 1), (1, 8, 2), (8, 1, 1), (8, 8, 2)]
    assert ivfpq.knn_ivf(requests, entries.limit(0), f"{scratch}/two", dim=2, lists=4, probes=4, sub=1).collect() == []
    assert ivfpq.knn_ivf(requests.limit(0), entries, f"{scratch}/three", dim=2, lists=4, probes=4, sub=1).collect() == []
    with pytest.raises(ValueError):
        ivfpq.fit(entries, dim=2, lists=1, sub=3)
