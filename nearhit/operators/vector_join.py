"""Exact cosine joins with a blocked matrix-product kernel.

Spark has no vector index and a non-equi join on cosine falls back to a
nested-loop join. Instead both sides are cut into hash blocks:

* query block ``qb = pmod(xxhash64(id), Bq)``, entry block ``ib`` likewise;
* every query row is replicated ``Be`` times and every entry row ``Bq`` times
  (``explode(sequence)``), so each ``(key, qb, ib)`` cogroup meets exactly one
  block of each side;
* inside a group, numpy does a float64 matrix product, applies masks (self,
  time order) and keeps the local top-k or the rows under the threshold; it
  holds ``SCORE_CHUNK_BYTES`` of scores at a time, and pairs under a threshold
  (or all pairs) leave the task chunk by chunk, so its memory does not grow with them;
* a window partitioned by the query id merges the ``Be`` local answers.

Shuffle volume is ``Be*|Q| + Bq*|E|`` rows. Block counts are picked from row
counts and vector width so one block holds about ``block_bytes`` and at most
``BLOCK_ROWS`` rows; a block is
a hash range of unique ids, so a hot key or hot value cannot make one group
large. Equal query vectors of one key are asked once. Distances are rounded
to 12 places, so equal vectors tie whatever block they are in, and a tie
goes to the smaller entry id: each query and block gives at most k rows. Optional ``key`` columns make it an equi-join on the key as well (e.g.
a private cache per user); then the block counts are chosen per key from that
key's own row counts, so a small key is one block pair with no replication
and a hot key (a third of all rows) is split like an unkeyed join.
Only ids, order columns and vectors enter the kernel; payload columns are
joined back afterwards by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK_BYTES = 16 << 20
SCORE_CHUNK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 15
OUT_ROWS = 1 << 17  # pairs in one Arrow batch
PLACES = 12
NEAR = 1e-10  # products so far apart may be one when distances are rounded to ``PLACES``, further ones are not
VECTOR_ID = ["_v1", "_v2"]  # the columns by which a row names its vector in a table of vectors


def _size(df: DataFrame, vec: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    return int(row["n"] or 0), int(row["d"] or 0)


def block_counts(n_q: int, n_e: int, dim: int, parallelism: int,
                 block_bytes: int = DEFAULT_BLOCK_BYTES) -> tuple[int, int]:
    """Blocks per side: about ``block_bytes`` each, and at least ``parallelism``
    block pairs so every core gets work (the larger side is split further)."""
    width = max(dim, 1) * 8
    bq = max(1, math.ceil(n_q * width / block_bytes), math.ceil(n_q / BLOCK_ROWS))
    be = max(1, math.ceil(n_e * width / block_bytes), math.ceil(n_e / BLOCK_ROWS))
    while bq * be < parallelism:
        if n_e >= n_q:
            be += 1
        else:
            bq += 1
        if bq * be >= max(n_q, 1) * max(n_e, 1):
            break
    return bq, be


def _stack(col: pd.Series) -> np.ndarray:
    """Unit rows of a column of vectors; null and zero vectors become NaN rows, which never match."""
    if len(col) == 0:
        return np.zeros((0, 0))
    width = max((len(v) for v in col.values if v is not None), default=0)
    lost = np.full(width, np.nan)
    flat = np.concatenate([lost if v is None else v for v in col.values]).astype(np.float64)
    if len(flat) != width * len(col):
        raise ValueError("vectors of different lengths in one column")
    m = flat.reshape(len(col), width)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        m = m / n
    m[~np.isfinite(m).all(axis=1)] = np.nan
    return m


def _nearest(dots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest of each row, those of product -inf never; of equal distances the first."""
    k = min(k, dots.shape[1])
    kth = dots.max(axis=1) if k == 1 else np.partition(dots, dots.shape[1] - k, axis=1)[:, -k]
    r, c = np.nonzero(dots >= np.maximum(kth - NEAR, -2.0)[:, None])  # the k nearest and those that rounding may bring level
    d = np.round(1.0 - dots[r, c], PLACES)
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    few = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[few], c[few], d[few]


def _scored(left: pd.DataFrame, right: pd.DataFrame, mode: str, k: int, max_distance: float, exclude_self: bool,
            ordered: bool, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of left, rows of right, distances) of the pairs that stay, a chunk of left rows at a time."""
    if len(left) == 0 or len(right) == 0:
        return
    Q, E = _stack(left["_v"]), _stack(right["_v"])
    if Q.shape[1] != E.shape[1]:
        raise ValueError(f"dimension mismatch: {Q.shape[1]} vs {E.shape[1]}")
    qid, eid = left["_id"].to_numpy(), right["_id"].to_numpy()
    qord = left["_o"].to_numpy() if ordered else None
    eord = right["_o"].to_numpy() if ordered else None
    lost_q, lost_e = np.isnan(Q).any(axis=1), np.flatnonzero(np.isnan(E).any(axis=1))
    chunk = max(1, SCORE_CHUNK_BYTES // (8 * len(right)))
    for s in range(0, len(left), chunk):
        sl = slice(s, s + chunk)
        D = Q[sl] @ E.T
        if mode == "threshold":  # masks and rounding for the pairs that can stay
            r, c = np.nonzero(D > 1.0 - max_distance - NEAR)
            d = np.round(1.0 - D[r, c], PLACES)
            stay = d < max_distance
            if exclude_self:
                stay &= qid[r + s] != eid[c]
            if upper:
                stay &= qid[r + s] < eid[c]
            if ordered:
                stay &= eord[c] < qord[r + s]
            yield r[stay] + s, c[stay], d[stay]
            continue
        D[lost_q[sl]] = -np.inf
        D[:, lost_e] = -np.inf
        if exclude_self:
            D[qid[sl][:, None] == eid[None, :]] = -np.inf
        if upper:
            D[~(qid[sl][:, None] < eid[None, :])] = -np.inf
        if ordered:
            D[~(eord[None, :] < qord[sl][:, None])] = -np.inf
        if mode == "knn":
            r, c, d = _nearest(D, k)
        elif mode == "steps":
            r, c, d = _steps(D, eid)
        else:  # all pairs
            r, c = np.nonzero(np.isfinite(D))
            d = np.round(1.0 - D[r, c], PLACES)
        yield r + s, c, d


def _steps(dots: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) where a row's nearest so far changes, entries in order; of equal distances a smaller id takes over."""
    level = np.maximum.accumulate(dots, axis=1)
    level -= NEAR
    r, c = np.nonzero(dots >= level)  # no other column can be one of them
    r, c = (x[dots[r, c] > -np.inf] for x in (r, c))
    at = np.arange(len(r)) - np.searchsorted(r, r)
    dist = np.full((len(dots), int(at.max(initial=-1)) + 1), np.inf)
    dist[r, at] = d = np.round(1.0 - dots[r, c], PLACES)
    if not len(r):
        return r, c, d
    low = np.minimum.accumulate(dist, axis=1)
    first = np.ones(dist.shape, bool)
    first[:, 1:] = dist[:, 1:] < low[:, :-1]
    first &= np.isfinite(dist)
    tied = (dist == low) & np.isfinite(dist) & ~first
    start = np.searchsorted(r, np.arange(len(dots)))
    for row in np.flatnonzero(tied.any(axis=1)):
        best = None
        for i in np.flatnonzero(first[row] | tied[row]):
            own = ids[c[start[row] + i]]
            if first[row, i] or own < best:
                best = own
                first[row, i] = True
    stay = first[r, at]
    return r[stay], c[stay], d[stay]


def _knn_kernel(k: int, exclude_self: bool, ordered: bool, upper: bool):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_id", kind="stable")  # so that the first of equal distances has the smallest id
        qid, eid = left["_id"].to_numpy(), right["_id"].to_numpy()
        out = [(qid[r], eid[c], d) for r, c, d in _scored(left, right, "knn", k, 2.0, exclude_self, ordered, upper)]
        out = out or [(qid[:0], eid[:0], np.zeros(0))]
        return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("_qid", "_eid", "_dist"), zip(*out))})
    return fn


def _steps_kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    right = right.sort_values(["_o", "_id"], kind="stable")
    qid, eid, seq = left["_id"].to_numpy(), right["_id"].to_numpy(), right["_o"].to_numpy()
    out = [(qid[r], eid[c], d, seq[c]) for r, c, d in _scored(left, right, "steps", 1, 2.0, False, False, False)]
    out = out or [(qid[:0], eid[:0], np.zeros(0), seq[:0])]
    return pd.DataFrame({name: np.concatenate(part) for name, part in zip(("_qid", "_eid", "_dist", "_seq"), zip(*out))})


def _pairs_kernel(mode: str, max_distance: float, exclude_self: bool, ordered: bool, upper: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        is_query = block.column("_query").combine_chunks()
        sides = []
        for name, rows in (("_qid", is_query), ("_eid", pc.invert(is_query))):
            side = block.filter(rows)
            sides.append((side.column(name).combine_chunks(), side.rename_columns({name: "_id"}).to_pandas()))
        del block
        (qid, left), (eid, right) = sides
        for r, c, d in _scored(left, right, mode, 0, max_distance, exclude_self, ordered, upper):
            for s in range(0, len(r), OUT_ROWS):
                sl = slice(s, s + OUT_ROWS)
                yield pa.record_batch([qid.take(pa.array(r[sl])), eid.take(pa.array(c[sl])), pa.array(d[sl])], names=["_qid", "_eid", "_dist"])
    return fn


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on key columns where null equals null (a null user has a cache of its own)."""
    named = right.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c).alias(c) for c in right.columns])
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in keys])
    return left.join(named, on).drop(*[f"_r{c}" for c in keys])


def _side(df: DataFrame, id_col: str, vec_col: str | None, order_col: str | None,
          key_cols: list[str]) -> DataFrame:
    cols = [F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)]
    cols += [F.col(id_col).alias("_id"), *([F.col(vec_col).alias("_v")] if vec_col else [F.col(c) for c in VECTOR_ID])]
    if order_col:
        cols.append(F.col(order_col).alias("_o"))
    return df.select(*cols)


def pair_distances(queries: DataFrame, entries: DataFrame, *, mode: str, k: int = 5,
                   max_distance: float = 2.0, query_id: str = "query_id", entry_id: str = "entry_id",
                   query_vec: str = "embedding", entry_vec: str = "embedding",
                   query_order: str | None = None, entry_order: str | None = None,
                   key: list[str] | None = None, exclude_self: bool = False, upper: bool = False,
                   block_bytes: int = DEFAULT_BLOCK_BYTES, vectors: DataFrame | None = None) -> DataFrame:
    """Raw kernel output ``(_qid, _eid, _dist)`` (local top-k in knn mode).

    ``vectors``: ``VECTOR_ID`` and ``embedding``, each vector once; both sides then name theirs by ``VECTOR_ID`` and
    meet them when their blocks are known, so that rows are counted and dealt without them.
    Mode ``steps`` gives ``_seq`` too, the entry's ``entry_order``: the entries, taken in that order within
    a block, that become a query's nearest."""
    key = list(key or [])
    ordered = query_order is not None
    spark = queries.sparkSession
    if vectors is None:
        n_q, d_q = _size(queries, query_vec)
        n_e, d_e = _size(entries, entry_vec)
    else:
        query_vec = entry_vec = None
        n_q, n_e = queries.count(), entries.count()
        d_q = d_e = _size(vectors, "embedding")[1]
    par = spark.sparkContext.defaultParallelism
    bq, be = block_counts(n_q, n_e, max(d_q, d_e), par, block_bytes)
    q = _side(queries, query_id, query_vec, query_order, key)
    e = _side(entries, entry_id, entry_vec, entry_order, key)
    kcols = [f"_k{i}" for i in range(len(key))]
    if key:
        # block counts per key: a small key gets one block pair (no
        # replication), a hot key is split like an unkeyed join
        width = max(d_q, d_e, 1) * 8
        nq = q.groupBy(*kcols).agg(F.count(F.lit(1)).alias("_nq"))
        ne = e.groupBy(*kcols).agg(F.count(F.lit(1)).alias("_ne"))
        per = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * width / F.lit(block_bytes)),
                                   F.ceil(F.col(n) / F.lit(BLOCK_ROWS))).cast("int")
        kb = _same_key(nq, ne, kcols).select(*kcols, per("_nq").alias("_bq"), per("_ne").alias("_be"))
        q, e = _same_key(q, kb, kcols), _same_key(e, kb, kcols)
        nbq, nbe = F.col("_bq"), F.col("_be")
    else:
        nbq, nbe = F.lit(bq), F.lit(be)
    if vectors is not None:
        q, e = (side.join(vectors.select(*VECTOR_ID, F.col("embedding").alias("_v")), VECTOR_ID).drop(*VECTOR_ID) for side in (q, e))
    # both sides' block numbers must be of one type, or the two sides of a block are hashed to different tasks
    q = (q.withColumn("_qb", F.pmod(F.xxhash64("_id"), nbq).cast("int"))
          .withColumn("_ib", F.explode(F.sequence(F.lit(0), (nbe - 1).cast("int")))))
    e = (e.withColumn("_ib", F.pmod(F.xxhash64("_id"), nbe).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), (nbq - 1).cast("int")))))
    gcols = kcols + ["_qb", "_ib"]
    qt = queries.schema[query_id].dataType.simpleString()
    et = entries.schema[entry_id].dataType.simpleString()
    schema = f"_qid {qt}, _eid {et}, _dist double"
    if mode == "knn":  # at most k rows a query and block
        fn, keep = _knn_kernel(k, exclude_self, ordered, upper), ["_id", "_v"] + (["_o"] if ordered else [])
        return (q.groupBy(*gcols).cogroup(e.groupBy(*gcols))
                 .applyInPandas(lambda l, r: fn(l[keep], r[keep]), schema))
    if mode == "steps":
        st = entries.schema[entry_order].dataType.simpleString()
        return (q.groupBy(*gcols).cogroup(e.groupBy(*gcols))
                 .applyInPandas(lambda l, r: _steps_kernel(l[["_id", "_v"]], r[["_id", "_v", "_o"]]), f"{schema}, _seq {st}"))
    pairs = _pairs_kernel(mode, max_distance, exclude_self, ordered, upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs(batches)

    q = q.withColumnRenamed("_id", "_qid").withColumns({"_eid": F.lit(None).cast(et), "_query": F.lit(True)})
    e = e.withColumnRenamed("_id", "_eid").withColumns({"_qid": F.lit(None).cast(qt), "_query": F.lit(False)})
    return q.unionByName(e.select(*q.columns)).groupBy(*gcols).applyInArrow(run, schema)


def knn(queries: DataFrame, entries: DataFrame, k: int = 5, **kw) -> DataFrame:
    """k nearest entries per query by cosine distance, ascending; ties by entry id.

    Returns ``(query_id, entry_id, distance, rank)``; fewer than k rows when
    the store is smaller. Queries with no candidate produce no rows. A query
    id is asked once; equal vectors of one key share one search (found by two 64-bit hashes).
    """
    qn, en = kw.get("query_id", "query_id"), kw.get("entry_id", "entry_id")
    vec, key = kw.get("query_vec", "embedding"), list(kw.get("key") or [])
    w = Window.partitionBy("_qid").orderBy(F.col("_dist").asc(), F.col("_eid").asc())
    if kw.get("query_order") or kw.get("exclude_self"):  # a query's own place counts: each is asked
        raw = pair_distances(queries, entries, mode="knn", k=k, **kw)
        ranked = raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    else:
        same = queries.select(qn, *key, F.col(vec).alias(vec), *[F.xxhash64(F.lit(i), vec, *key).alias(f"_h{i}") for i in (1, 2)])
        asked = same.groupBy("_h1", "_h2").agg(F.min_by(F.struct(qn, *key, vec), qn).alias("_one")).select("_one.*", "_h1", "_h2")
        raw = pair_distances(asked.drop("_h1", "_h2"), entries, mode="knn", k=k, **kw)
        best = raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        best = best.join(asked.select(F.col(qn).alias("_qid"), "_h1", "_h2"), "_qid").drop("_qid")
        ranked = best.join(same.select(F.col(qn).alias("_qid"), "_h1", "_h2"), ["_h1", "_h2"])
    return ranked.select(F.col("_qid").alias(qn), F.col("_eid").alias(en), F.col("_dist").alias("distance"), F.col("rank"))


def nearest_one(queries: DataFrame, entries: DataFrame, **kw) -> DataFrame:
    """Single nearest entry per query: ``(query_id, entry_id, distance)``."""
    return knn(queries, entries, k=1, **kw).drop("rank")


def nearest_by_time(queries: DataFrame, entries: DataFrame, *, order: str, query_id: str = "query_id", entry_id: str = "entry_id",
                    key: list[str] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """How each query's nearest entry changes as entries come in ``order``: ``(query_id, entry_id, distance, after, until)``.

    The row with ``after < t <= until`` (``until`` null: for ever) holds the nearest of the entries before ``t``, ties to the smaller entry id.
    A query vector is so searched once, however often it is asked. Entries without a place in the order never come."""
    raw = pair_distances(queries, entries.where(F.col(order).isNotNull()), mode="steps", query_id=query_id, entry_id=entry_id,
                         entry_order=order, key=key, vectors=vectors)
    w = Window.partitionBy("_qid").orderBy("_seq", "_dist", "_eid")
    near = F.struct("_dist", "_eid")
    before = F.min(near).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = raw.withColumn("_before", before).where(F.col("_before").isNull() | (near < F.col("_before")))
    return steps.select(F.col("_qid").alias(query_id), F.col("_eid").alias(entry_id), F.col("_dist").alias("distance"),
                        F.col("_seq").alias("after"), F.lead("_seq").over(w).alias("until"))


def similarity_join(left: DataFrame, right: DataFrame | None = None, *, max_distance: float,
                    **kw) -> DataFrame:
    """All pairs with cosine distance strictly below ``max_distance``.

    With ``right=None`` it is a self-join returning each unordered pair once
    (``left id < right id``).
    """
    qn, en = kw.get("query_id", "query_id"), kw.get("entry_id", "entry_id")
    if right is None:
        right = left
        kw.setdefault("entry_id", qn)
        en = kw["entry_id"]
        kw["upper"] = True
    raw = pair_distances(left, right, mode="threshold", max_distance=max_distance, **kw)
    ln, rn = (qn, en) if qn != en else (f"{qn}_a", f"{en}_b")
    return raw.select(F.col("_qid").alias(ln), F.col("_eid").alias(rn), F.col("_dist").alias("distance"))


def similarity_matrix(df: DataFrame, *, id_col: str = "id", vec_col: str = "embedding",
                      upper: bool = False) -> DataFrame:
    """All pairs ``(id_a, id_b, similarity)``; ``upper`` keeps ``id_a < id_b`` only."""
    raw = pair_distances(df, df, mode="all", query_id=id_col, entry_id=id_col,
                         query_vec=vec_col, entry_vec=vec_col, upper=upper)
    return raw.select(F.col("_qid").alias(f"{id_col}_a"), F.col("_eid").alias(f"{id_col}_b"),
                      (F.lit(1.0) - F.col("_dist")).alias("similarity"))
