"""Hashed embedder: unit norms, pair scores against a plain loop, and plans without a shuffle."""

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearhit.functions.text import normalize_text
from nearhit.operators import embed as E
from nearhit.operators.embed_store import EmbeddingStore, PredictEmbedder
from nearhit.plans import fixtures as X

from conftest import SF_SMALL

MODELS = {"a": E.HashedEmbedder(0, 256, 3), "b": E.HashedEmbedder(7, 10_000, 1), "raw": E.HashedEmbedder(1, 64, 2, normalize=False)}


def vector(text, m):
    words = [w for w in (text or "").split(" ") if w]
    c = Counter(int(hashlib.md5(f"{m.seed}:{' '.join(words[i:i + m.n])}".encode()).hexdigest()[:8], 16) % m.dim
                for i in range(len(words) - m.n + 1))
    norm = math.sqrt(sum(v * v for v in c.values()))
    return {k: v / norm for k, v in c.items()}


def test_unit_norm_without_a_shuffle(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sp = MODELS["a"].sparse(docs, "doc_id", "text")
    assert "Exchange" not in sp._jdf.queryExecution().executedPlan().toString()
    norms = sp.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert norms and all(abs(r["n"] - 1.0) < 1e-9 for r in norms)


def test_pair_scores_equal_a_plain_loop(spark):
    extra = spark.createDataFrame([(10 ** 6, None, "a b c", 1), (10 ** 6 + 1, "", "a b c d", 0), (10 ** 6 + 2, "x y z", "x y z", None),
                                   (10 ** 6 + 3, "one", "one", 1)], "id long, question1 string, question2 string, is_duplicate int")
    qp = X.question_pairs(spark, SF_SMALL).select(extra.columns).unionByName(extra)
    scored = E.score_pairs(qp, MODELS)
    got = {(r.model_key, r.id): (r.similarity, r.is_duplicate) for r in scored.collect()}
    rows = qp.select("id", "question1", "question2", "is_duplicate", normalize_text("question1").alias("n1"), normalize_text("question2").alias("n2")).collect()
    assert len(got) == 3 * len(rows)
    for key, m in MODELS.items():
        for r in rows:
            a, b = (vector(t, m) for t in ((r.n1, r.n2) if m.normalize else (r.question1, r.question2)))
            want = sum(v * b.get(k, 0.0) for k, v in a.items()) if a and b else None
            sim, label = got[(key, r.id)]
            assert label == r.is_duplicate
            assert (sim is None) == (want is None) and (want is None or sim == pytest.approx(want, abs=1e-9))


def test_a_text_is_embedded_once_in_two_runs(spark, scratch):
    @dataclass(frozen=True)
    class Counting(E.HashedEmbedder):
        """Counts the texts that it is asked to embed."""
        calls: object = None

        def counted(self, texts):
            self.calls.add(len(texts))
            return E.HashedEmbedder.counted(self, texts)

    texts = ["a b c d", "b c d e", "a b c d", None, "", "x y"]
    pairs = spark.createDataFrame([(i, texts[i % 6], texts[(i * 5 + 1) % 6], i % 2) for i in range(40)],
                                  "id long, question1 string, question2 string, is_duplicate int").repartition(5)
    calls = [spark.sparkContext.accumulator(0) for _ in range(2)]
    models = {"one": Counting(0, 256, 2, calls=calls[0]), "two": Counting(1, 64, 1, calls=calls[1])}
    store = EmbeddingStore(spark, f"{scratch}/store")
    first = {(r.model_key, r.id): r.similarity for r in store.score_pairs(pairs, {"one": models["one"]}).collect()}
    assert calls[0].value == 4 and calls[1].value == 0  # four distinct texts
    both = {(r.model_key, r.id): r.similarity for r in store.score_pairs(pairs, models).collect()}
    assert calls[0].value == 4 and calls[1].value == 4
    more = pairs.unionByName(spark.createDataFrame([(99, "new text here", "a b c d", 1)], pairs.schema))
    assert len(store.score_pairs(more, models).collect()) == 82
    assert calls[0].value == calls[1].value == 5 and store.table().count() == 10
    assert all(both[k] == v for k, v in first.items())
    plain = {(r.model_key, r.id): r.similarity for r in E.score_pairs(pairs, {"one": E.HashedEmbedder(0, 256, 2), "two": E.HashedEmbedder(1, 64, 1)}).collect()}
    assert plain == both and both[("one", 0)] == pytest.approx(2 / 3)


def test_store_takes_a_dense_model(spark, scratch):
    def make_predict():
        return lambda texts: [[len(t), t.count("a")] for t in texts]
    store = EmbeddingStore(spark, f"{scratch}/store")
    pairs = spark.createDataFrame([(1, "aa", "a"), (2, "aaa", "bbb"), (3, None, "a"), (4, "", "a")], "id long, question1 string, question2 string")
    got = {r.id: r.similarity for r in store.score_pairs(pairs, {"m": PredictEmbedder(make_predict, 2)}, label=None).collect()}
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(math.sqrt(0.5)) and got[3] is None and got[4] is None
    assert store.ensure(pairs.select(F.col("question1").alias("text")), {"m": PredictEmbedder(make_predict, 2)}) == 0
    with pytest.raises(ValueError):
        store.ensure(pairs.select(F.col("question1").alias("text")), {"a/b": PredictEmbedder(make_predict, 2)})


def test_dense_equals_sparse(spark):
    df = spark.createDataFrame([(1, "a b c d a b c"), (2, "a"), (3, None)], "id long, text string")
    m = E.HashedEmbedder(3, 32, 2)
    got = {r.id: r.embedding for r in m(df).collect()}
    assert got[2] is None and got[3] is None
    want = np.zeros(32)
    for k, v in vector("a b c d a b c", m).items():
        want[k] = v
    assert np.allclose(got[1], want)


def test_model_embedder_runs_a_model_on_batches(spark):
    def make_predict():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)
    df = spark.createDataFrame([(1, "  Aa  b "), (2, "xyz")], "id long, text string")
    got = {r.id: list(r.embedding) for r in E.model_embedder(make_predict, 2)(df).collect()}
    assert got == {1: [4.0, 2.0], 2: [3.0, 0.0]}


def test_texts_are_hashed_in_slices_of_bounded_size(monkeypatch):
    from nearhit.operators import embed_store as ES
    texts = ["a b c d e", None, "", "b c d", "x y", "c d e f g h i", "q r s t"] * 5
    sizes, whole = [], E.HashedEmbedder._counted
    want = E.HashedEmbedder(3, 64).counted(texts)
    monkeypatch.setattr(E.HashedEmbedder, "_counted", lambda self, t: sizes.append(sum(len(x or "") for x in t)) or whole(self, t))
    monkeypatch.setattr(E, "slices", lambda t, size=20, real=E.slices: real(t, size))
    got = E.HashedEmbedder(3, 64).counted(texts)
    assert all((a == b).all() for a, b in zip(got, want)) and len(sizes) > 5 and max(sizes) <= 20
    assert list(E.slices([])) == [(0, 0)] and len(E.HashedEmbedder().counted([])[0]) == 0
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    b, w = lists([[1, 3], None, [], [2, 4, 9]] * 9, pa.int32()), lists([[0.6, 0.8], None, [], [0.5, 0.5, 0.7]] * 9, pa.float64())
    before = ES.cosines(b, w, b, w)
    monkeypatch.setattr(ES, "CELLS", 7)
    assert np.array_equal(ES.cosines(b, w, b, w), before, equal_nan=True) and before[0] == pytest.approx(1.0)
