"""Score statistics that add up: a quantile sketch and moments a group, stored and merged.

``score_sketches`` reads scores once and makes one narrow row a group: Spark's KLL
sketch of the valid scores and the parts of their moments. Such rows of any number of
runs, splits or classes are kept in a table (``append_sketches``) and merged later, without the
scores: ``merge_sketches`` gives count, mean, population deviation, extremes and a
merged sketch, ``quantiles`` reads values off it. The map side sends sketches of
about ``k`` numbers to the shuffle, so a hot group costs no more than another.

A quantile read for rank p has a true rank within ``rank_error(k)`` of p with 99% confidence, whatever the
number of scores and merges; twice that is over five standard deviations. Moments
and extremes are exact. Null and NaN scores count nowhere; a group of only such ones stays, with n = 0 and nulls. The
exact median of one table is ``metrics.similarity_stats``, at the price of a second reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhit.operators.metrics import _moments, moment_columns
from nearhit.session import exists

K = 1024
PARTS = [f"_m_{x}" for x in ("n", "s", "q", "r", "lo", "hi")]


def rank_error(k: int = K) -> float:
    """Bound of a quantile's rank error at 99% confidence, as published for KLL sketches of size ``k``."""
    return 2.296 / k ** 0.9723


def score_sketches(scored: DataFrame, by: list[str], sim: str = "similarity", k: int = K) -> DataFrame:
    """``by``, ``sketch`` and the parts of the moments: one row a group, from one reading of ``scored``."""
    v = F.col(sim).cast("double")
    rows = scored.select(*by, F.when(v.isNotNull() & ~F.isnan(v), v).alias("_v"))
    parts = {n: c for n, (_, c) in _moments("_m", F.col("_v")).items()}
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), *[parts[n].alias(n) for n in PARTS])


def append_sketches(sketches: DataFrame, path: str) -> None:
    """Add one run's rows to the table at ``path``; Spark commits them as a whole."""
    sketches.write.mode("append").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``score_sketches`` merged to the coarser groups ``by``; mergeable again."""
    how = {"lo": F.min, "hi": F.max}
    parts = [how.get(n[-2:], F.sum)(n).alias(n) for n in PARTS]
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), *parts)


def quantiles(sketches: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """``by, n, sim_mean, sim_std, sim_min, sim_max`` and a column ``p<percent>`` for each of ``probs``."""
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError(f"quantiles lie between 0 and 1: {probs}")
    some = F.col("_m_n") > 0
    read = [F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(column(p)) for p in probs]
    return sketches.select(*by, F.col("_m_n").alias("n"), *moment_columns("_m", "sim"), *read)


def column(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def rank_errors(scored: DataFrame, found: DataFrame, by: list[str], probs: list[float], sim: str = "similarity") -> DataFrame:
    """How far each quantile of ``found`` is from the ranks that its value has in ``scored`` (0 where it lies among them).

    An audit that reads the scores; columns ``<name>_error`` beside ``by``, null for a group without a score."""
    got = found.select(*by, *[F.col(column(p)).alias(f"_q{i}") for i, p in enumerate(probs)])
    g = [F.col(f"`{c}`").eqNullSafe(F.col(f"_g_{c}")) for c in by]
    got = got.select(*[F.col(f"`{c}`").alias(f"_g_{c}") for c in by], *[f"_q{i}" for i in range(len(probs))])
    valid = scored.where(F.col(sim).isNotNull() & ~F.isnan(sim))
    v, n = F.col(sim), F.count(F.lit(1))
    aggs = [F.greatest(F.count_if(v < F.col(f"_q{i}")) / n - p, p - F.count_if(v <= F.col(f"_q{i}")) / n, F.lit(0.0)).alias(f"{column(p)}_error")
            for i, p in enumerate(probs)]
    return got.join(valid, g, "left").groupBy(*[F.col(f"_g_{c}").alias(c) for c in by]).agg(
        *[F.when(F.count(v) > 0, a).alias(f"{column(p)}_error") for a, p in zip(aggs, probs)])
