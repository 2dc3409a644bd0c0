"""Approximate cosine kNN: an inverted file with product-quantised codes and exact rerank.

* ``fit``: centroids by spherical k-means on a bounded sample of entries (those
  of the smallest hashed ids), started from the sample's first rows; the code
  book of each sub-space is the first ``codes`` rows' part in it. Both are
  small arrays whose size the caller sets.
* ``build``: every entry goes to the list of its nearest centroid, with one
  code a sub-space. The index is a Parquet table in ``FOLDERS`` folders of lists.
* ``search``: a query probes its ``probes`` nearest lists; only their folders
  are read, and a query goes to a folder once, with the lists it probes there. Scores come from a table of products
  of the query with all codes, looked up code by code; the best ``rerank`` entries of a query are compared
  exactly. Folders of many entries or queries are split on both sides, so no group grows with the data.

Recall is a matter of ``probes`` and ``rerank``, to be measured on the data in hand (``recall_at_k``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhit.functions.ids import hash32
from nearhit.functions.vector import cosine_similarity_batched

FOLDERS = 64
LIST_ROWS, LIST_QUERIES = 8192, 2048  # of one group of the search
SCORE_CELLS = 1 << 20  # scores held at a time


@dataclass(frozen=True)
class IvfPq:
    """Centroids (list, dim), unit rows, and code books (sub-space, code, dim / sub-spaces)."""
    centroids: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def nearest_lists(self, v: np.ndarray, many: int) -> np.ndarray:
        """The ``many`` lists of the largest dot products of each row, ties to the smaller list."""
        step = max(1, SCORE_CELLS // len(self.centroids))
        return np.concatenate([np.argsort(-(v[a:a + step] @ self.centroids.T), axis=1, kind="stable")[:, :many] for a in range(0, max(1, len(v)), step)])

    def encode(self, v: np.ndarray) -> np.ndarray:
        """(row, sub-space) codes: the nearest book entry, ties to the smaller code."""
        sub, _, width = self.books.shape
        parts = v.reshape(len(v), sub, width)
        return np.stack([((parts[:, s, None] - self.books[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(sub)], axis=1)


def unit_rows(lists: pd.Series | pa.Array, dim: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False) if isinstance(lists, pa.Array) else np.concatenate([*lists, np.zeros(0)])
    v = flat.astype(np.float64).reshape(-1, dim)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vec: str, dim: int) -> Column:
    """A vector of ``dim`` finite components that are not all zero."""
    return (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)


def fit(entries: DataFrame, *, dim: int, lists: int, sub: int = 16, codes: int = 64, rounds: int = 3, sample: int = 20_000, seed: int = 7,
        entry_id: str = "entry_id", vec: str = "embedding") -> IvfPq | None:
    """Centroids and code books from at most ``sample`` entries; None without a usable one."""
    if dim % sub:
        raise ValueError(f"{sub} sub-spaces do not divide {dim} components")
    rows = entries.where(usable(vec, dim)).select(F.col(entry_id).alias("id"), vec)
    got = rows.orderBy(hash32(seed, "id"), "id").limit(sample).select(vec).toArrow()
    if not got.num_rows:
        return None
    v = unit_rows(got[vec].combine_chunks(), dim)
    centroids = v[:lists].copy()
    for _ in range(rounds):
        near = (v @ centroids.T).argmax(axis=1)
        sums = np.stack([np.bincount(near, v[:, d], len(centroids)) for d in range(dim)], axis=1)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)  # an empty list stays where it is
    return IvfPq(centroids, v[:codes].reshape(-1, sub, dim // sub).transpose(1, 0, 2).copy())


def build(entries: DataFrame, model: IvfPq, path: str, *, entry_id: str = "entry_id", vec: str = "embedding") -> None:
    """Writes the index of all usable entries, (id, codes, list), by ``folder`` (the list modulo ``FOLDERS``)."""
    rows = entries.where(usable(vec, model.dim)).select(F.col(entry_id).alias("id"), F.col(vec).alias("v"))
    shared = entries.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            v = unit_rows(batch.column(1), model.dim)
            codes = model.encode(v).astype(np.uint16).tobytes()
            width = 2 * len(model.books)
            yield pa.record_batch([batch.column(0), pa.array([codes[i * width:(i + 1) * width] for i in range(len(v))], pa.binary()),
                                   pa.array(model.nearest_lists(v, 1)[:, 0].astype(np.int32))], names=["id", "codes", "list"])

    placed = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, codes binary, list int")
    placed.withColumn("folder", F.col("list") % FOLDERS).write.partitionBy("folder").mode("overwrite").parquet(path)


def search(queries: DataFrame, entries: DataFrame, model: IvfPq, path: str, *, k: int = 5, probes: int = 16, rerank: int = 100,
           query_id: str = "query_id", entry_id: str = "entry_id", vec: str = "embedding") -> DataFrame:
    """``(query_id, entry_id, distance, rank)`` of the k nearest entries found; exact distances, rounded to 12 places, ties to the smaller id."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(model)
    asked = queries.where(usable(vec, model.dim)).select(F.col(query_id).alias("qid"), F.col(vec).alias("qv"))

    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = shared.value.nearest_lists(unit_rows(batch.column(1), shared.value.dim), probes).astype(np.int32)
            key = np.repeat(np.arange(len(near)), near.shape[1]) * FOLDERS + near.ravel() % FOLDERS
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            offsets = pa.array(np.append(first, len(order)).astype(np.int32))
            row = pa.array(key[order][first] // FOLDERS)
            yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array((key[order][first] % FOLDERS).astype(np.int32)),
                                   pa.ListArray.from_arrays(offsets, pa.array(near.ravel()[order]))], names=["qid", "qv", "folder", "lists"])

    kinds = dict(asked.dtypes)
    probed = asked.mapInArrow(lists_of, f"qid {kinds['qid']}, qv {kinds['qv']}, folder int, lists array<int>")
    index = spark.read.parquet(path)
    queries_of = {r["folder"]: r["count"] for r in probed.groupBy("folder").count().collect()}  # at most one row a folder
    index = index.where(F.col("folder").isin(list(queries_of)))  # only folders that are probed
    entries_of = {r["folder"]: r["count"] for r in index.groupBy("folder").count().collect()}
    parts = spark.createDataFrame([(c, -(-queries_of[c] // LIST_QUERIES), -(-n // LIST_ROWS)) for c, n in entries_of.items()], "folder int, nq int, ne int")

    def dealt(rows: DataFrame, own: str, n_own: str, other: str, n_other: str, by: str) -> DataFrame:
        placed = rows.join(F.broadcast(parts), "folder").withColumn(own, F.pmod(F.xxhash64(by), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))

    left = dealt(probed, "qp", "nq", "ep", "ne", "qid").select("folder", "qp", "ep", "qid", "qv", "lists")
    right = dealt(index, "ep", "ne", "qp", "nq", "id").select("folder", "qp", "ep", "id", "codes", "list")

    def best(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        model, out = shared.value, []
        if not len(q) or not len(e):
            return pd.DataFrame({"qid": q["qid"][:0], "id": e["id"][:0], "score": np.zeros(0)})
        e = e.sort_values(["list", "id"], ignore_index=True)
        sub, _, width = model.books.shape
        codes = np.frombuffer(b"".join(e["codes"]), np.uint16).reshape(len(e), sub)
        names, first = np.unique(e["list"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(e))
        v = unit_rows(q["qv"], model.dim).reshape(len(q), sub, width)
        size = q["lists"].map(len).to_numpy()
        row, probe = np.repeat(np.arange(len(q)), size), np.concatenate(q["lists"].tolist())
        step = max(1, SCORE_CELLS // max(len(e), sub * model.books.shape[1]))
        for a in range(0, len(q), step):
            looked = np.einsum("qsd,scd->qsc", v[a:a + step], model.books)  # products of each query with all codes
            score = np.full((len(looked), len(e)), -np.inf)
            for name, lo, hi in zip(names, first, ends):
                who = row[(probe == name) & (row >= a) & (row < a + step)] - a
                if len(who):
                    score[who, lo:hi] = sum(looked[who, s][:, codes[lo:hi, s]] for s in range(sub))
            top = np.argsort(-score, axis=1, kind="stable")[:, :rerank]
            good = np.take_along_axis(score, top, 1)
            at, place = np.nonzero(good > -np.inf)
            out.append(pd.DataFrame({"qid": q["qid"].to_numpy()[a + at], "id": e["id"].to_numpy()[top[at, place]], "score": good[at, place]}))
        return pd.concat(out, ignore_index=True)

    types = f"qid {kinds['qid']}, id {dict(index.dtypes)['id']}, score double"
    found = left.groupBy("folder", "qp", "ep").cogroup(right.groupBy("folder", "qp", "ep")).applyInPandas(best, types)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rerank).select("qid", "id")
    whole = found.join(asked, "qid").join(entries.select(F.col(entry_id).alias("id"), F.col(vec).alias("ev")), "id")
    told = whole.select("qid", "id", F.round(1 - cosine_similarity_batched("qv", "ev"), 12).alias("distance"))
    w = Window.partitionBy("qid").orderBy("distance", "id")
    ranked = told.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(query_id), F.col("id").alias(entry_id), "distance", "rank")


def knn_ivf(queries: DataFrame, entries: DataFrame, path: str, k: int = 5, *, dim: int, lists: int, probes: int, rerank: int = 100, sub: int = 16,
            codes: int = 64, seed: int = 7, query_id: str = "query_id", entry_id: str = "entry_id", vec: str = "embedding") -> DataFrame:
    """Fits, builds and searches in one call; no rows where no entry is usable."""
    model = fit(entries, dim=dim, lists=lists, sub=sub, codes=codes, seed=seed, entry_id=entry_id, vec=vec)
    if model is None:
        kinds = {**dict(queries.dtypes), **dict(entries.dtypes)}
        return queries.sparkSession.createDataFrame([], f"{query_id} {kinds[query_id]}, {entry_id} {kinds[entry_id]}, distance double, rank int")
    build(entries, model, path, entry_id=entry_id, vec=vec)
    return search(queries, entries, model, path, k=k, probes=probes, rerank=rerank, query_id=query_id, entry_id=entry_id, vec=vec)
