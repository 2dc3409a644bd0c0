"""Exact ranks and cuts at given ranks without a single-partition window.

Rows are counted per bucket, where a bucket is a range of the order. The
buckets' offsets are running sums in levels of 1,024, so that no window
holds more rows than that, and only the buckets that hold a wanted rank are
looked into. ``first_ranks`` turns ranks into predicates on the row itself:
wide rows are filtered where they lie, never shuffled or joined back.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhit.functions.ids import hash32

ROWS_PER_BUCKET = 50_000
FAN_OUT = 1024
#: Hash code of a null id: above every 32-bit hash, so null ids stand last.
NULL_HASH = 1 << 32


def bucket_offsets(counts: DataFrame, buckets: int) -> DataFrame:
    """(_bk, _cnt, _off): rows in earlier buckets, from (_bk, _cnt) with 0 <= _bk < ``buckets``.

    Sums go up level by level until one level has at most 1,024 rows."""
    if buckets <= FAN_OUT:
        w = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("_bk", "_cnt", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    child = counts.withColumn("_up", F.floor(F.col("_bk") / FAN_OUT).cast("long"))
    up = bucket_offsets(child.groupBy(F.col("_up").alias("_bk")).agg(F.sum("_cnt").alias("_cnt")), -(-buckets // FAN_OUT))
    w = Window.partitionBy("_up").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    inner = child.withColumn("_in", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return inner.join(up.select(F.col("_bk").alias("_up"), F.col("_off").alias("_base")), "_up").select(
        "_bk", "_cnt", (F.col("_base") + F.col("_in")).alias("_off"))


def global_rank(df: DataFrame, order: list[Column], bucket: Column, buckets: int, rank_col: str = "_rank") -> DataFrame:
    """Add a 1-based rank by ``order``. ``bucket`` is monotone in it, never null and below ``buckets``."""
    b = df.withColumn("_bk", bucket.cast("long"))
    offsets = bucket_offsets(b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_cnt")), buckets)
    return (b.join(offsets.select("_bk", "_off"), "_bk")
             .withColumn(rank_col, F.col("_off") + F.row_number().over(Window.partitionBy("_bk").orderBy(*order)))
             .drop("_bk", "_off"))


def hash_bucket_bits(n_rows: int) -> int:
    """Number of top hash bits so buckets hold about ``ROWS_PER_BUCKET`` rows."""
    return min(32, max(0, math.ceil(math.log2(max(1, n_rows / ROWS_PER_BUCKET)))))


def _row_hash(df: DataFrame) -> Column:
    """64-bit hash of the whole row, unsigned order not needed: it only breaks ties."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def hash_rank(df: DataFrame, seed, id_col: str, rank_col: str = "_rank") -> DataFrame:
    """Exact rank of rows ordered by ``(md5-hash(seed:id), id)``.

    Null ids come last, ordered among themselves by a hash of the row and
    bucketed by it, so that many of them are many buckets."""
    bits = hash_bucket_bits(df.count())
    tie = _row_hash(df)
    h = F.coalesce(hash32(seed, id_col), F.lit(NULL_HASH) + F.shiftrightunsigned(tie, 32))
    bucket = F.shiftright(F.col("_h"), 32 - bits)
    return global_rank(df.withColumn("_h", h).withColumn("_t", tie), [F.col("_h"), F.col(id_col), F.col("_t")], bucket,
                       2 << bits, rank_col).drop("_h", "_t")


def _at_most(cols: list[Column], values: list, strict: bool) -> Column:
    """Lexicographic ``cols < values`` (or ``<=``); a null column equals a null value and is above all else."""
    last = F.lit(False) if strict else F.lit(True)
    for c, v in reversed(list(zip(cols, values))):
        same, below = c.eqNullSafe(F.lit(v)), (c.isNotNull() if v is None else F.coalesce(c < F.lit(v), F.lit(False)))
        last = below | (same & last)
    return last


def _cuts(df: DataFrame, key: list[Column], bucket: Column, buckets: int, ranks: list[int]) -> dict[int, tuple]:
    """rank -> (key of the row there, rows of that key within the rank, rows of that key)."""
    names = [f"_k{i}" for i in range(len(key))]
    narrow = df.select(bucket.cast("long").alias("_bk"), *[c.alias(n) for c, n in zip(key, names)])
    offsets = bucket_offsets(narrow.groupBy("_bk").agg(F.count(F.lit(1)).alias("_cnt")), buckets)
    inside = reduce(Column.__or__, [(F.col("_off") < r) & (F.col("_off") + F.col("_cnt") >= r) for r in ranks])
    hit = {row["_bk"]: row["_off"] for row in offsets.where(inside).collect()}  # at most one bucket a rank
    if not hit:
        return {}
    per = narrow.where(F.col("_bk").isin(list(hit))).groupBy("_bk", *names).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_bk").orderBy(*[F.col(n).asc_nulls_last() for n in names])
    offset = reduce(lambda c, kv: c.when(F.col("_bk") == kv[0], F.lit(kv[1])), hit.items(), F.when(F.lit(False), F.lit(0)))
    run = per.withColumn("_end", offset + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = reduce(Column.__or__, [(F.col("_end") - F.col("_c") < r) & (F.col("_end") >= r) for r in ranks])
    out = {}
    for row in run.where(inside).collect():
        for r in ranks:
            if row["_end"] - row["_c"] < r <= row["_end"]:
                out[r] = ([row[n] for n in names], r - (row["_end"] - row["_c"]), row["_c"])
    return out


def first_ranks(df: DataFrame, key: list[Column], bucket: Column, buckets: int, ranks: list[int]) -> dict[int, tuple]:
    """rank -> (predicate, predicate of the last key, rows of it wanted) for the first rows of an order.

    The first predicate holds for the rows surely within the rank. Rows of
    equal key at the cut are ordered by a hash of the row. Only rows that
    are equal in that too are left over: the second predicate finds them, and so many of them
    still belong to the first ``rank`` (none left over: 0). Ranks beyond the table have no entry."""
    tie = _row_hash(df)
    out = {}
    for r, (values, wanted, there) in _cuts(df, key, bucket, buckets, sorted(set(ranks))).items():
        below = _at_most(key, values, strict=True)
        equal = reduce(Column.__and__, [c.eqNullSafe(F.lit(v)) for c, v in zip(key, values)])
        if wanted == there:
            out[r] = (below | equal, F.lit(False), 0)
            continue
        bits = hash_bucket_bits(there)
        spread = F.shiftright(tie, 32) + F.lit(1 << 31)  # 0 .. 2^32 - 1, in the order of the hash
        (h,), inner, same = _cuts(df.where(equal), [tie], F.shiftright(spread, 32 - bits), 1 << bits, [wanted])[wanted]
        within = below | (equal & (tie < F.lit(h)))
        last = equal & (tie == F.lit(h))
        out[r] = (within | last, F.lit(False), 0) if inner == same else (within, last, inner)
    return out


def hash_order(df: DataFrame, seed, id_col: str) -> tuple[list[Column], Column, int]:
    """(key, bucket, buckets) of the seeded order of ids; null ids last."""
    h = F.coalesce(hash32(seed, id_col), F.lit(NULL_HASH))
    bits = hash_bucket_bits(df.count())
    return [h, F.col(id_col)], F.shiftright(h, 32 - bits), (1 << bits) + 1


def range_order(df: DataFrame, order: str) -> tuple[DataFrame, list[Column], Column, int]:
    """(df with ``_range``, key, bucket, buckets) of a numeric column's order; null last.

    Bucket bounds are approximate percentiles, so far-off values do not
    empty the buckets; equal values share a bucket and count as one key there."""
    n = df.where(F.col(order).isNotNull()).count()
    want = min(4096, max(1, math.ceil(n / ROWS_PER_BUCKET)))
    bounds = []
    if want > 1:
        shares = [i / want for i in range(1, want)]
        found = df.agg(F.percentile_approx(order, shares, 10 * want)).first()[0] or []
        bounds = sorted({float(b) for b in found if not math.isnan(float(b))})
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_range_key", outputCol="_range", handleInvalid="keep")
    out = cut.transform(df.withColumn("_range_key", F.col(order).cast("double"))).drop("_range_key")
    # "keep" puts null and NaN into one more bucket; null goes one further
    bucket = F.when(F.col(order).isNull(), F.lit(len(splits))).otherwise(F.col("_range").cast("long"))
    return out, [F.col(order)], bucket, len(splits) + 1


def running_total(df: DataFrame, order: str, weight: str, out: str = "_before") -> DataFrame:
    """Add the sum of ``weight`` over the rows of smaller ``order`` (numeric, distinct, not null)."""
    ranged, _, bucket, buckets = range_order(df, order)
    b = ranged.withColumn("_bk", bucket.cast("long")).drop("_range")
    offsets = bucket_offsets(b.groupBy("_bk").agg(F.sum(weight).alias("_cnt")), buckets)
    w = Window.partitionBy("_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (b.join(offsets.select("_bk", "_off"), "_bk")
             .withColumn(out, F.col("_off") + F.coalesce(F.sum(weight).over(w), F.lit(0))).drop("_bk", "_off"))
