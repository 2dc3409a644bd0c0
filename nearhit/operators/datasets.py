"""Pair-dataset preparation: cleaning, samples, splits, folds, balance.

Randomness comes from ``md5(seed ':' id)`` so every split and sample is
reproducible, independent of partitioning, and stable when rows are added.
Exact-size variants find the row keys at the wanted ranks (``first_ranks``)
and compare rows with them: whole rows are never shuffled, and null ids or
order values stand last instead of getting lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhit.functions.ids import hash32, hash_unit
from nearhit.functions.text import strip_ws
from nearhit.operators.rank import first_ranks, hash_order, range_order

PAIR_COLS = ["id", "qid1", "qid2", "question1", "question2", "is_duplicate"]


def label_01(c: str = "is_duplicate") -> Column:
    """The label as an int where it is exactly 0 or 1 (as ``1`` or ``1.0``, number or text); else null."""
    x = F.expr(f"try_cast({c} AS double)")
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def _keep() -> Column:
    return (F.col("question1").isNotNull() & F.col("question2").isNotNull() & label_01().isNotNull()
            & (strip_ws("question1") != "") & (strip_ws("question2") != ""))


def clean_pairs(df: DataFrame) -> DataFrame:
    """Drop rows with a null question or label, a label other than 0 and 1, or a
    blank question; the label becomes an int."""
    return df.where(_keep()).withColumn("is_duplicate", label_01())


def clean_report(df: DataFrame) -> DataFrame:
    """Rows before / after cleaning and the share kept, in one aggregate pass."""
    r = df.agg(F.count(F.lit(1)).alias("original_rows"), F.count_if(F.coalesce(_keep(), F.lit(False))).alias("valid_rows"))
    return r.select("original_rows", "valid_rows", (F.col("original_rows") - F.col("valid_rows")).alias("removed_rows"),
                    F.when(F.col("original_rows") > 0, F.col("valid_rows") / F.col("original_rows") * 100)
                    .otherwise(F.lit(0.0)).alias("valid_pct"))


def _first(df: DataFrame, n: int, key: list[Column], bucket: Column, buckets: int) -> DataFrame:
    """The first ``n`` rows of an order; all of them if there are fewer."""
    if n <= 0:
        return df.where(F.lit(False))
    found = first_ranks(df, key, bucket, buckets, [n])
    if n not in found:
        return df
    within, last, wanted = found[n]
    # rows equal in every column: any of them will do
    return df.where(within) if not wanted else df.where(within).union(df.where(last).limit(wanted))


def head_n(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """First ``n`` rows in ``order`` (numeric order column, null last; ties by a hash of the row)."""
    ranged, *how = range_order(df, order)
    return _first(ranged, n, *how).drop("_range")


def sample_n(df: DataFrame, n: int, seed=42, id_col: str = "id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows chosen by seeded hash order; null ids come last."""
    return _first(df, n, *hash_order(df, seed, id_col))


def subset(df: DataFrame, predicate) -> DataFrame:
    return df.where(predicate)


def _parts(df: DataFrame, ends: list[int], labels: list, key: list[Column], bucket: Column, buckets: int) -> Column:
    """Label of each row: that of the first of the ``ends`` (rising ranks) it lies within, else the last label.

    Rows equal in every column that straddle an end all go to the later part."""
    found = first_ranks(df, key, bucket, buckets, [e for e in ends if e > 0])
    out = None
    for end, label in zip(ends, labels):
        within = F.lit(False) if end <= 0 else found[end][0] if end in found else F.lit(True)
        out = F.when(within, F.lit(label)) if out is None else out.when(within, F.lit(label))
    return F.lit(labels[-1]) if out is None else out.otherwise(F.lit(labels[-1]))


def _fold_ends(n: int, k: int) -> list[int]:
    """Last rank of each fold but the last, where fold = floor((rank - 1) * k / n)."""
    return [-(-j * n // k) for j in range(1, k)]


def k_folds(df: DataFrame, k: int, seed=42, id_col: str = "id", exact: bool = False) -> DataFrame:
    """Fold id 0..k-1 per row: by hash (default; null ids in fold 0), or ``exact`` contiguous folds
    of equal size over the seeded order."""
    if not exact:
        return df.withColumn("fold", F.coalesce(F.pmod(hash32(seed, id_col), F.lit(k)), F.lit(0)).cast("int"))
    return df.withColumn("fold", _parts(df, _fold_ends(df.count(), k), list(range(k)), *hash_order(df, seed, id_col)).cast("int"))


def k_folds_contiguous(df: DataFrame, k: int, order: str = "id") -> DataFrame:
    """``k`` contiguous folds of equal size over the table's numeric ``order`` column
    (null last): fold = floor((rank - 1) * k / n)."""
    ranged, *how = range_order(df, order)
    return ranged.withColumn("fold", _parts(ranged, _fold_ends(df.count(), k), list(range(k)), *how).cast("int")).drop("_range")


def class_balance(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """Duplicate share, flagged below 10% or above 90%."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("duplicate_share"))
    return r.withColumn("imbalanced", (F.col("duplicate_share") < 0.1) | (F.col("duplicate_share") > 0.9))


def _check_fractions(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"train, val and test shares add up to {train + val + test} instead of 1")


def split_three_way(df: DataFrame, train: float = 0.5, val: float = 0.3, test: float = 0.2,
                    seed=42, id_col: str = "id") -> DataFrame:
    """Hash split: ``u = md5-hash(seed:id) / 2^32``; no shuffle, stable under growth."""
    _check_fractions(train, val, test)
    u = F.coalesce(hash_unit(seed, id_col), F.lit(0.0))  # null ids: train
    split = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return df.withColumn("split", split)


def split_three_way_exact(df: DataFrame, train: float = 0.5, val: float = 0.3, test: float = 0.2,
                          seed=42, id_col: str = "id") -> DataFrame:
    """Exact sizes as a two-step split: test = ceil(n * test), then val =
    ceil(rest * val / (train + val)); the rest is train. Rows are ordered by
    the seeded hash."""
    _check_fractions(train, val, test)
    n = df.count()
    n_test = math.ceil(n * test)
    n_val = math.ceil((n - n_test) * (val / (train + val)))
    ends, labels = [n_test, n_test + n_val], ["test", "val", "train"]
    return df.withColumn("split", _parts(df, ends, labels, *hash_order(df, seed, id_col)))


def split_balance(df: DataFrame, label: str = "is_duplicate", split_col: str = "split") -> DataFrame:
    """Per split (and ``Original`` for all rows): rows, duplicates and
    non-duplicates with their percentages, by one rollup."""
    d = F.col(label) == 1
    r = df.rollup(split_col).agg(F.count(F.lit(1)).alias("rows"), F.count_if(d).alias("duplicates"),
                                 F.count_if(F.col(label) == 0).alias("non_duplicates"))
    pct = lambda c: F.when(F.col("rows") > 0, F.col(c) / F.col("rows") * 100).otherwise(F.lit(0.0))
    return r.select(F.coalesce(F.col(split_col), F.lit("Original")).alias(split_col), "rows", "duplicates",
                    pct("duplicates").alias("duplicate_pct"), "non_duplicates",
                    pct("non_duplicates").alias("non_duplicate_pct"))


def split_filter(df: DataFrame, split: str | None, split_col: str = "split") -> DataFrame:
    """``split in {train, val, test, full}``; ``full`` keeps all rows."""
    if split is None or split == "full":
        return df
    if split not in ("train", "val", "test"):
        raise ValueError(f"Invalid split: {split}")
    return df.where(F.col(split_col) == split)
