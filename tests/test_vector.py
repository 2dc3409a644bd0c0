"""Block kernel against numpy brute force, and plan shape checks."""

import numpy as np
from pyspark.sql import functions as F

from nearhit.operators import vector_join as J
from nearhit.plans import fixtures as X

from conftest import SF_MID, SF_SMALL


def _unit(rows):
    m = np.array([r for r in rows], dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_knn_matches_brute_force(spark):
    q, e = X.requests(spark, SF_SMALL), X.entries(spark, SF_SMALL)
    qr = sorted(q.select("query_id", "embedding").collect())
    er = sorted(e.select("entry_id", "embedding").collect())
    D = 1.0 - _unit([r[1] for r in qr]) @ _unit([r[1] for r in er]).T
    exp = {}
    for i, r in enumerate(qr):
        order = sorted(range(len(er)), key=lambda j: (D[i, j], er[j][0]))[:5]
        exp[r[0]] = [er[j][0] for j in order]
    got = {}
    for r in J.knn(q, e, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["entry_id"])
    assert got == exp


def test_similarity_join_self(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = sorted(emb.collect())
    U = _unit([r["embedding"] for r in rows])
    D = 1.0 - U @ U.T
    exp = {(rows[i]["vec_id"], rows[j]["vec_id"]) for i in range(len(rows)) for j in range(len(rows))
           if rows[i]["vec_id"] < rows[j]["vec_id"] and D[i, j] < 0.7}
    got = {(r[0], r[1]) for r in J.similarity_join(emb, max_distance=0.7, query_id="vec_id").collect()}
    assert got == exp


def test_block_counts_scale():
    assert J.block_counts(10, 10, 64, 8) [0] * J.block_counts(10, 10, 64, 8)[1] >= 8
    bq, be = J.block_counts(10**9, 10**9, 768, 1000)
    assert bq * be >= 1000 and bq > 1000  # ~64 MB blocks on both sides


def test_knn_plan_has_no_nested_loop(spark):
    q, e = X.requests(spark, SF_SMALL), X.entries(spark, SF_SMALL)
    plan = J.knn(q, e, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "FlatMapCoGroupsInPandas" in plan


def test_lsh_recall_on_planted_duplicates(spark):
    from pyspark.sql import functions as F
    from nearhit.operators.lsh import knn_approx, recall_at_k
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    entries = emb.select(F.col("vec_id").alias("entry_id"), "embedding")
    # each query is a slightly perturbed copy of one entry: its true neighbour is planted
    noisy = F.transform("embedding", lambda x: x + (F.rand(seed=5) - 0.5) * 0.02)
    queries = emb.select((F.col("vec_id") + 100000).alias("query_id"), noisy.alias("embedding"))
    exact = J.knn(queries, entries, k=1)
    approx = knn_approx(queries, entries, k=1, dim=64, bands=16, bits=6)
    r = recall_at_k(approx, exact).first()
    assert r["recall"] >= 0.95


def test_lsh_defaults_find_the_real_neighbours(spark):
    from nearhit.operators.lsh import knn_approx, recall_at_k
    q, e = X.requests(spark, SF_MID), X.entries(spark, SF_MID)
    r = recall_at_k(knn_approx(q, e, k=5, dim=64), J.knn(q, e, k=5)).first()
    assert r["exact_pairs"] == 5 * q.count() and r["recall"] >= 0.9


def test_lsh_with_one_bucket_is_exact(spark, monkeypatch):
    from nearhit.operators.lsh import knn_approx
    q, e = X.requests(spark, SF_SMALL), X.entries(spark, SF_SMALL)
    exact = {(r[0], r[1], r[2]) for r in J.knn(q, e, k=3).select("query_id", "entry_id", "rank").collect()}
    # no bits: all entries in one bucket, which the kernel splits into blocks
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    got = {(r[0], r[1], r[2]) for r in knn_approx(q, e, k=3, dim=64, bands=1, bits=0).select("query_id", "entry_id", "rank").collect()}
    assert got == exact


def test_ties_give_exactly_k_rows_by_id(spark, monkeypatch):
    e = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], "entry_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [2.0, 0.0]) for i in range(50)] + [(99, [0.0, 0.0]), (98, None)], "query_id long, embedding array<double>")
    monkeypatch.setattr(J, "BLOCK_ROWS", 64)
    got = sorted((r.query_id, r["rank"], r.entry_id) for r in J.knn(q, e, k=2).collect())
    assert got == sorted((i, k + 1, k) for i in range(50) for k in range(2))
    raw = J.pair_distances(q, e, mode="knn", k=2)
    assert raw.count() <= 50 * 2 * 8 * 8  # at most k a query and block


def test_null_keys_meet(spark):
    q = spark.createDataFrame([(1, None, [1.0, 0.0]), (2, 7, [1.0, 0.0])], "query_id long, user long, embedding array<double>")
    e = spark.createDataFrame([(10, None, [1.0, 0.1]), (11, 7, [1.0, 0.2]), (12, 8, [1.0, 0.0])], "entry_id long, user long, embedding array<double>")
    assert sorted((r.query_id, r.entry_id) for r in J.knn(q, e, k=5, key=["user"]).collect()) == [(1, 10), (2, 11)]


def test_blocks_meet_when_partitions_are_not_coalesced(spark, monkeypatch):
    q, e = X.requests(spark, SF_SMALL), X.entries(spark, SF_SMALL).withColumn("user_id", F.col("entry_id") % 7)
    keys = [None, ["user_id"]]
    found = lambda: [sorted((r.query_id, r["rank"], r.entry_id, round(r.distance, 9)) for r in J.knn(q, e, k=3, key=k).collect())
                     for k in keys]
    want = found()
    monkeypatch.setattr(J, "BLOCK_ROWS", 20)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = found()
    finally:
        spark.conf.set(name, "true")
    assert got == want and len(want[0]) == 3 * q.count()


def test_kernels_hold_a_bounded_chunk_of_scores(spark):
    import tracemalloc

    import pandas as pd
    import pyarrow as pa
    rng = np.random.default_rng(1)
    side = lambda: pd.DataFrame({"_id": np.arange(4000), "_v": list(rng.normal(size=(4000, 8)))})
    left, right = side(), side()
    tracemalloc.start()
    near = J._knn_kernel(1, False, False, False)(left, right)
    assert len(near) == 4000 and tracemalloc.get_traced_memory()[1] < 10 * J.SCORE_CHUNK_BYTES < 4000 * 4000 * 8
    tracemalloc.reset_peak()
    rows = [pa.record_batch([pa.array(f["_id"] if q else [None] * 4000, pa.int64()), pa.array([None] * 4000 if q else f["_id"], pa.int64()),
                             pa.array(f["_v"].tolist(), pa.list_(pa.float64())), pa.array([q] * 4000)], names=["_qid", "_eid", "_v", "_query"])
            for f, q in ((left, True), (right, False))]
    pairs = 0
    for batch in J._pairs_kernel("all", 2.0, False, False, True)(iter(rows)):
        assert batch.num_rows <= J.OUT_ROWS
        pairs += batch.num_rows
    assert pairs == 4000 * 3999 // 2 and tracemalloc.get_traced_memory()[1] < 15 * J.SCORE_CHUNK_BYTES < pairs * 24
    tracemalloc.stop()


def test_pairs_of_all_modes_match_numpy(spark, monkeypatch):
    """Blocks, chunks and Arrow batches of odd sizes, a null and a zero vector, other types on each side."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    q, e = ([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 4)))] for _ in range(2))
    Q, E = (_unit([v for _, v in x]) for x in (q, e))
    qs = spark.createDataFrame([*q, (90, None), (91, [0.0] * 4)], "query_id long, embedding array<double>")
    es = spark.createDataFrame([(f"e{i}", v) for i, v in e] + [("z", None)], "entry_id string, embedding array<double>")
    got = {(r.query_id, r.entry_id): r.distance for r in J.similarity_join(qs, es, max_distance=0.5).collect()}
    D = 1 - Q @ E.T
    want = {(i, f"e{j}"): D[i, j] for i in range(30) for j in range(30) if D[i, j] < 0.5}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    every = J.similarity_matrix(qs, id_col="query_id").collect()
    assert len(every) == 30 * 30 and all(abs(r.similarity - Q[r.query_id_a] @ Q[r.query_id_b]) < 1e-9 for r in every)


def test_nearest_by_time_matches_brute_force(spark, monkeypatch):
    """Equal distances, equal times, a null time and blocks of odd size."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 3))
    e = [(int(i), base[rng.integers(12)].tolist(), int(rng.integers(25))) for i in rng.permutation(40)] + [(99, base[0].tolist(), None)]
    q = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 3)))]
    got = {}
    for r in J.nearest_by_time(spark.createDataFrame(q, "query_id long, embedding array<double>"),
                               spark.createDataFrame(e, "entry_id long, embedding array<double>, seq long"), order="seq").collect():
        for t in range(r["after"] + 1, (26 if r["until"] is None else r["until"]) + 1):
            assert (r["query_id"], t) not in got
            got[r["query_id"], t] = r["entry_id"]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for i, v in q:
        for t in range(27):
            near = min(((round(1 - float(unit(v) @ unit(x)), 12), j) for j, x, s in e if s is not None and s < t), default=None)
            if near:
                want[i, t] = near[1]
    assert got == want


def test_kernel_rounds_and_masks_only_what_can_stay(monkeypatch):
    """Nearest, steps and pairs under a threshold equal the plain definition on rounded distances, with ties, copies and lost vectors."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(12)
    vecs = [*rng.normal(size=(40, 4)).tolist(), *rng.integers(-1, 2, (80, 4)).astype(float).tolist(), None, [0.0] * 4]
    sides = [pd.DataFrame({"_id": rng.permutation(len(vecs)), "_v": vecs, "_o": rng.permutation(len(vecs))}).sample(frac=1, random_state=k) for k in (1, 2)]
    left, right = sides[0].sort_values("_id"), sides[1].sort_values("_o")
    D = np.round(1 - J._stack(left["_v"]) @ J._stack(right["_v"]).T, J.PLACES)
    D[np.isnan(D)] = np.inf
    qid, eid, qo, eo = left["_id"].to_numpy(), right["_id"].to_numpy(), left["_o"].to_numpy(), right["_o"].to_numpy()
    full, rounded = np.round, []
    monkeypatch.setattr(J.np, "round", lambda x, *a, **b: rounded.append(np.size(x)) or full(x, *a, **b))

    def got(mode, k=1, most=2.0, **masks):
        on = {"exclude_self": False, "ordered": False, "upper": False} | masks
        return {(int(r), int(c)): d for part in J._scored(left, right, mode, k, most, **on) for r, c, d in zip(*part)}

    for mask, name in ((qid[:, None] == eid, "exclude_self"), (qid[:, None] >= eid, "upper"), (eo >= qo[:, None], "ordered")):
        E = np.where(mask, np.inf, D)
        for k in (1, 4):
            want = {(r, int(c)): E[r, c] for r in range(len(E)) for c in np.argsort(E[r], kind="stable")[:k] if np.isfinite(E[r, c])}
            assert got("knn", k, **{name: True}) == want
        assert got("threshold", most=0.5, **{name: True}) == {(int(r), int(c)): E[r, c] for r, c in zip(*np.nonzero(E < 0.5))}
    want = {}
    for r in range(len(D)):
        best = (np.inf, None)
        for c in np.flatnonzero(np.isfinite(D[r])):
            if (D[r, c], eid[c]) < best:
                best = want[r, int(c)] = (D[r, c], eid[c])
    assert {k: d for k, d in got("steps").items()} == {k: v[0] for k, v in want.items()}
    rounded.clear()
    pairs = got("threshold", most=0.05)
    assert sum(rounded) < 2 * len(pairs) + 100 < D.size  # not every pair is rounded
