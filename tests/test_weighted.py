"""Document-frequency weights and the dense subspace, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhit.functions.text import normalize_text
from nearhit.operators import embed as E
from nearhit.operators import weighted as W

from conftest import SF_SMALL

BASE = E.HashedEmbedder(3, 512, 1)
EDGES = [(10 ** 6, None), (10 ** 6 + 1, ""), (10 ** 6 + 2, "?!"), (10 ** 6 + 3, "single")]


@pytest.fixture(scope="module")
def docs(spark):
    more = spark.createDataFrame(EDGES, "doc_id long, text string")
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(more).repartition(70)


@pytest.fixture(scope="module")
def matrix(docs):
    """Weighted rows in plain numpy, from unweighted counts."""
    texts = [r.n for r in docs.orderBy("doc_id").select(normalize_text("text").alias("n")).collect()]
    row, bucket, weight = BASE.counted(texts)
    m = np.zeros((len(texts), BASE.dim))
    m[row, bucket] = weight
    some = (m > 0).any(axis=1)
    idf = np.log((1 + some.sum()) / (1 + (m > 0).sum(axis=0))) + 1
    m *= idf
    m[some] /= np.linalg.norm(m[some], axis=1)[:, None]
    return m, idf, some


def test_idf_equals_numpy(docs, matrix):
    m, idf, some = matrix
    fitted = W.fit_idf(docs, BASE)
    assert np.allclose(fitted.weights, idf, rtol=1e-12)
    ids = {r.doc_id: i for i, r in enumerate(docs.orderBy("doc_id").select("doc_id").collect())}
    got = np.zeros_like(m)
    for r in fitted.sparse(docs, "doc_id", "text").collect():
        got[ids[r.doc_id], r.bucket] = r.weight
    assert np.allclose(got, m, atol=1e-12) and 0 < some.sum() < len(some)


def test_weighted_embedder_serves_pair_scores(spark, docs):
    fitted = W.fit_idf(docs, BASE)
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat ran", 1), (2, None, "x", 0)],
                                  "id long, question1 string, question2 string, is_duplicate int")
    got = {(r.model_key, r.id): r.similarity for r in E.score_pairs(pairs, {"plain": BASE, "idf": fitted}).collect()}
    assert got[("plain", 1)] == pytest.approx(2 / 3) and got[("idf", 1)] != pytest.approx(2 / 3, abs=1e-3) and got[("idf", 2)] is None


def test_subspace_is_nearly_the_best_one(docs, matrix):
    m, _, some = matrix
    rank = 12
    v = W.fit_subspace(docs, W.fit_idf(docs, BASE), rank, passes=4)
    assert v.shape == (BASE.dim, rank) and np.allclose(v.T @ v, np.eye(rank), atol=1e-9)
    best = np.sqrt((np.linalg.svd(m, compute_uv=False)[rank:] ** 2).sum())
    assert best <= np.linalg.norm(m - m @ v @ v.T) <= 1.02 * best
    got = {r.doc_id: r for r in W.embed_dense(docs, W.fit_idf(docs, BASE), v).collect()}
    for i, d in enumerate(sorted(got)):
        want = m[i] @ v
        if not some[i]:
            assert got[d].embedding is None and got[d].kept is None
        else:
            assert got[d].kept == pytest.approx(np.linalg.norm(want)) and np.allclose(got[d].embedding, want / np.linalg.norm(want))


def test_one_pass_through_small_blocks_gives_the_sums(spark, docs, matrix, monkeypatch):
    m, _, _ = matrix
    monkeypatch.setattr(W, "CELLS", 3 * BASE.dim)
    monkeypatch.setattr(W, "FAN", 4)  # several levels of merging
    w = np.random.default_rng(1).standard_normal((BASE.dim, 6))
    rows = W.sparse_lists(docs, W.fit_idf(docs, BASE))
    r, c = W._pass(rows, w, BASE.dim)
    y = m @ w
    assert np.allclose(c, y.T @ m) and np.allclose(r.T @ r, y.T @ y) and np.allclose(np.tril(r, -1), 0)


def test_low_rank_and_empty_corpora(spark):
    few = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "doc_id long, text string")
    fitted = W.fit_idf(few, BASE)
    v = W.fit_subspace(few, fitted, 8)
    assert v.shape == (BASE.dim, 2)  # two different rows span two directions
    out = W.embed_dense(few.withColumn("kept", F.lit("x")), fitted, v).orderBy("doc_id").collect()
    assert [None if r.kept is None else round(r.kept, 9) for r in out] == [1.0, 1.0, 1.0, None]
    none = few.where("false")
    assert (W.fit_idf(none, BASE).weights == 1).all() and W.fit_subspace(none, BASE, 4).shape == (BASE.dim, 0)
    assert W.embed_dense(few, fitted, np.zeros((BASE.dim, 0))).where("embedding IS NOT NULL").isEmpty()
    for bad in ({"rank": 0}, {"rank": BASE.dim + 1}, {"rank": 2, "passes": 0}):
        with pytest.raises(ValueError):
            W.fit_subspace(few, fitted, **bad)
