"""Readers and writers: CSV escapes and NA tokens, split folders, JSON results."""

import os

from pyspark.sql import functions as F

from nearhit.sources import pairs as P


def test_read_pairs_csv_quirks(spark, scratch):
    path = os.path.join(scratch, "questions.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,qid1,qid2,question1,question2,is_duplicate\n')
        f.write('1,1,2,"What is \\"ML\\"?","Define ML",1\n')
        f.write('2,3,4,"multi\nline","x",0\n')
        f.write('3,5,6,NA,"y",1\n')
        f.write('4,7,8,"a","b",2\n')
    df = P.read_pairs(spark, path=path).orderBy("id").collect()
    assert df[0]["question1"] == 'What is "ML"?' and df[0]["is_duplicate"] == 1
    assert df[1]["question1"] == "multi\nline"
    assert df[2]["question1"] is None
    assert df[3]["is_duplicate"] == 2


def test_read_pairs_split_names(spark):
    import pytest
    with pytest.raises(ValueError):
        P.read_pairs(spark, split="holdout")


def test_write_and_read_splits(spark, scratch):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).cast("int").alias("is_duplicate"),
                                 F.when(F.col("id") < 50, "train").when(F.col("id") < 80, "val")
                                  .otherwise("test").alias("split"))
    P.write_splits(df, scratch)
    assert P.read_split(spark, scratch, "val").count() == 30
    assert P.read_split(spark, scratch, "full").count() == 100
    plan = P.read_split(spark, scratch, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_statements_and_results_json(spark, scratch):
    p = os.path.join(scratch, "statements.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("  first statement \n\n second\n   \n")
    assert [r[0] for r in P.read_statements(spark, p).collect()] == ["first statement", "second"]
    res = spark.createDataFrame([("a", True, 0.9), ("b", False, None)], "model_key string, success boolean, t double")
    out = os.path.join(scratch, "res")
    P.write_results_json(res, out)
    back = P.read_results_json(spark, out, "model_key string, success boolean, t double")
    assert P.first_success(back).first()["model_key"] == "a"
