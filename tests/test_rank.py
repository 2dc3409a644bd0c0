"""Ranks, cuts, samples, splits and folds: every row kept, at every size and under skew."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearhit.operators import datasets as D
from nearhit.operators import rank as R


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 500)


def table(spark, n=6000):
    return spark.range(n).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("id"), F.col("id").alias("payload"))


def test_null_ids_are_kept_above_the_bucket_size(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 50_000)
    df = table(spark, 60_000).cache()
    split = D.split_three_way_exact(df)
    assert Counter(r[0] for r in split.select("split").collect()) == {"test": 12_000, "val": 18_000, "train": 30_000}
    for n in (1, 30_000, 59_900, 60_000, 70_000):
        for got in (D.sample_n(df, n), D.head_n(df, n)):
            assert got.count() == min(n, 60_000) == got.select("payload").distinct().count()
    assert Counter(r[0] for r in D.k_folds(df, 4, exact=True).select("fold").collect()) == {i: 15_000 for i in range(4)}
    assert Counter(r[0] for r in D.k_folds_contiguous(df, 4).select("fold").collect()) == {i: 15_000 for i in range(4)}
    df.unpersist()


def test_hash_rank_is_a_permutation_with_nulls_last(spark):
    df = table(spark)
    got = R.hash_rank(df, 42, "id").collect()
    assert sorted(r["_rank"] for r in got) == list(range(1, 6001))
    assert all(r["_rank"] > 5940 for r in got if r["id"] is None)


def test_head_n_orders_ties_far_values_and_nulls(spark):
    rows = [(i, float(i)) for i in range(3000)] + [(5000 + i, 7.0) for i in range(2000)] + [(9000, 1e18), (9001, float("nan")), (9002, None)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(7)
    key = lambda x: (x is None, x is not None and math.isnan(x), 0.0 if x is None or math.isnan(x) else x)
    values = sorted((x for _, x in rows), key=key)
    for n in (1, 8, 9, 1500, 2008, 2009, 4999, 5001, 5002, 5003, 6000):
        got = D.head_n(df, n, "x").collect()
        assert len(got) == min(n, len(rows)) and len({r.id for r in got}) == len(got)
        assert [str(v) for v in sorted((r.x for r in got), key=key)] == [str(v) for v in values[:n]]


def test_equal_rows_can_be_cut(spark):
    df = spark.range(3000).selectExpr("1 AS id", "'same' AS v")
    assert D.sample_n(df, 1234).count() == 1234 and D.head_n(df, 1234).count() == 1234
    assert D.sample_n(df, 0).count() == 0 and D.head_n(df.limit(0), 5).count() == 0


def test_a_far_value_does_not_empty_the_buckets(spark):
    df = spark.range(20_000).union(spark.createDataFrame([(10 ** 15,)], "id long"))
    ranged, _, bucket, buckets = R.range_order(df, "id")
    sizes = [r["count"] for r in ranged.groupBy(bucket.alias("b")).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_offsets_in_levels(spark, monkeypatch):
    monkeypatch.setattr(R, "FAN_OUT", 4)
    counts = spark.range(100).selectExpr("id AS _bk", "id % 7 + 1 AS _cnt")
    got = {r["_bk"]: r["_off"] for r in R.bucket_offsets(counts, 100).collect()}
    run = 0
    for i in range(100):
        assert got[i] == run
        run += i % 7 + 1


def test_running_total(spark):
    df = spark.range(5000).selectExpr("id * 3 AS id", "id % 5 AS w").repartition(5)
    got = {r.id: r["_before"] for r in R.running_total(df, "id", "w").collect()}
    run = 0
    for i in range(5000):
        assert got[3 * i] == run
        run += i % 5


@pytest.mark.parametrize("label,want", [("1", 1), ("1.0", 1), ("0.0", 0), ("0", 0), ("0.7", None), ("1.9", None), ("2", None), ("yes", None), (None, None)])
def test_label_rule(spark, label, want):
    df = spark.createDataFrame([(label,)], "is_duplicate string")
    assert df.select(D.label_01()).first()[0] == want
