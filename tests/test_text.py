"""Golden normalisation results and numbering removal."""

import pytest
from pyspark.sql import functions as F

from nearhit.functions.text import clean_lines, normalize_text, strip_numbering

GOLDEN = [
    ("  What   IS\tML ???  ", "what is ml? ?"),
    ("Hello!!world", "hello! !world"),
    ("a , b", "a, b"),
    ("3.14 and 1,000", "3.14 and 1,000"),
    ("see http://a.com/x_y @me", "see http: a. com x_y me"),
    ("wait...", "wait. ."),
    ("Étè  ½ x²", "étè ½ x²"),
]


@pytest.mark.parametrize("raw,expected", GOLDEN)
def test_normalize_golden(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "t string").select(normalize_text("t")).first()[0]
    assert got == expected


def test_normalize_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "t string").select(normalize_text("t")).collect()
    assert [r[0] for r in rows] == [None, ""]


def test_variant_lines(spark):
    text = "1. a\n2) b\n\n  - c  \n3D printing"
    got = (spark.createDataFrame([(text,)], "t string")
           .select(F.transform(clean_lines("t"), lambda x: strip_numbering(x))).first()[0])
    assert got == ["a", "b", "c", "D printing"]
