"""Quantile sketches: exact moments, ranks within the stated bound, whatever the way of merging."""

import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from nearhit.operators import sketch as S
from nearhit.session import ensure_checkpoint_dir

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
DDL = "model string, cls int, similarity double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [("big", i % 2, rng.gauss(0.5, 0.2)) for i in range(60_000)]
    out += [("ties", i % 2, rng.choice([0.1, 0.1, 0.9])) for i in range(5_000)]
    out += [(None, 0, float(i)) for i in range(7)] + [("one", 1, 0.25), ("bad", 0, None), ("bad", 1, float("nan")), ("big", 0, None)]
    rng.shuffle(out)
    return out


def valid(rows, model):
    return sorted(v for m, _, v in rows if m == model and v is not None and v == v)


def check(rows, found):
    assert {r.model for r in found} == {m for m, _, _ in rows}
    for r in found:
        vals = valid(rows, r.model)
        assert r.n == len(vals)
        if not vals:
            assert all(r[c] is None for c in ("sim_mean", "sim_std", "sim_min", "sim_max", "p50"))
            continue
        assert r.sim_mean == pytest.approx(statistics.fmean(vals)) and r.sim_std == pytest.approx(statistics.pstdev(vals), abs=1e-9)
        assert (r.sim_min, r.sim_max) == (vals[0], vals[-1])
        for p in PROBS:
            q = r[S.column(p)]
            below, upto = sum(v < q for v in vals) / len(vals), sum(v <= q for v in vals) / len(vals)
            assert q in vals and below - 2 * S.rank_error() <= p <= upto + 2 * S.rank_error() + (1 / len(vals))


def test_one_reading(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    check(rows, S.quantiles(S.score_sketches(df, ["model"]), ["model"], PROBS).collect())
    assert S.score_sketches(df, ["model"])._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_stored_and_merged_in_two_levels(spark, rows):
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    with pytest.raises(FileNotFoundError):
        S.read_sketches(spark, path)
    for part in (rows[:20_000], rows[20_000:]):  # two runs
        S.append_sketches(S.score_sketches(spark.createDataFrame(part, DDL), ["model", "cls"]), path)
    stored = S.read_sketches(spark, path)
    by_class = S.merge_sketches(stored, ["model", "cls"])
    assert by_class.count() == len({(m, c) for m, c, _ in rows}) < stored.count()
    check(rows, S.quantiles(S.merge_sketches(by_class, ["model"]), ["model"], PROBS).collect())


def test_audit_agrees_with_a_plain_count(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    found = S.quantiles(S.score_sketches(df, ["model"]), ["model"], [0.25, 0.5])
    wrong = found.withColumn("p25", F.when(F.col("model") == "ties", 0.9).otherwise(F.col("p25")))
    got = {r.model: r for r in S.rank_errors(df, wrong, ["model"], [0.25, 0.5]).collect()}
    share = sum(v < 0.9 for v in valid(rows, "ties")) / 5_000
    assert got["ties"].p25_error == pytest.approx(share - 0.25)
    assert got["big"].p50_error <= 2 * S.rank_error() and got["one"].p50_error == 0 and got["bad"].p50_error is None and None in got


def test_edges(spark):
    none = spark.createDataFrame([], DDL)
    assert S.quantiles(S.score_sketches(none, ["model"]), ["model"], [0.5]).count() == 0
    whole = S.quantiles(S.score_sketches(none, []), [], [0.5]).first()
    assert whole.n == 0 and whole.p50 is None
    with pytest.raises(ValueError):
        S.quantiles(S.score_sketches(none, ["model"]), ["model"], [1.5])
    assert S.column(0.999) == "p99_9"
