"""Embedders that know their corpus: inverse document frequencies and a dense subspace.

``fit_idf`` counts in how many texts each hash bucket occurs (one vector of counts
a task, summed by bucket) and gives a ``WeightedEmbedder``: hashed counts
times ``ln((1 + N) / (1 + n)) + 1``, scaled to unit length, where N is the number of texts with
an n-gram and n the number of those in the bucket. It serves wherever a
``HashedEmbedder`` does, the embedding store included.

``fit_subspace`` finds the ``rank`` directions that hold most of the corpus by a
randomised range finder. With A the texts' sparse rows and W a thin
matrix (random at first), one pass makes Y = A W block by block; each task keeps
the R factor of its part of Y (a tall-skinny QR: a block is stacked below the R so far) and
the sum of Yᵀ A. Tasks' parts are merged ``FAN`` at a time, level by level, so
what a task or the driver holds is a few matrices of ``width x dim``, whatever the corpus. Then Q = Y R⁺
is an orthonormal basis of the range, B = Qᵀ A = R⁺ᵀ (Yᵀ A), and W becomes an orthonormal
basis of B's rows for the next pass. The singular vectors of the last B
are the subspace. The sparse rows are computed once and written to the shared folder; each pass reads them.

Fitted arrays are bounded by ``dim`` (idf) and ``dim x rank`` (subspace), and travel in closures. A fit is
another model: store it under a key of its own. Null texts and texts without an n-gram count nowhere and have
no vector. An empty corpus gives weights of 1 and a subspace of no direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhit.operators.embed import HashedEmbedder, slices
from nearhit.session import Scratch

CELLS = 1 << 21  # numbers of a dense block of rows
FAN = 32  # parts merged at a time


@dataclass(frozen=True, eq=False)
class WeightedEmbedder(HashedEmbedder):
    """``HashedEmbedder`` whose counts are weighted by bucket before they are scaled to unit length."""
    weights: np.ndarray | None = None

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, bucket, weight = super().counted(texts)
        weight = weight * self.weights[bucket]
        norm = np.sqrt(np.bincount(row, weight * weight, len(texts)))
        return row, bucket, weight / norm[row]


def bucket_frequencies(df: DataFrame, embedder: HashedEmbedder, text_col: str = "text") -> DataFrame:
    """``(bucket, docs)``: texts that have an n-gram in the bucket; bucket -1 holds the texts with any n-gram."""
    dim = embedder.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = np.zeros(dim + 1, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in slices(texts):
                row, bucket, _ = embedder.counted(texts[a:z])
                docs[:dim] += np.bincount(bucket, minlength=dim)
                docs[dim] += len(np.unique(row))
        at = np.flatnonzero(docs)
        yield pa.record_batch([pa.array(np.where(at == dim, -1, at)), pa.array(docs[at])], names=["bucket", "docs"])

    return (df.select(embedder.prepared(text_col).alias("_t")).mapInArrow(run, "bucket long, docs long")
            .groupBy("bucket").agg(F.sum("docs").alias("docs")))


def fit_idf(df: DataFrame, embedder: HashedEmbedder, text_col: str = "text") -> WeightedEmbedder:
    """``embedder`` weighted by inverse document frequency over all texts of ``df`` (``dim + 1`` counts come to the driver)."""
    found = {r["bucket"]: r["docs"] for r in bucket_frequencies(df, embedder, text_col).collect()}
    total = found.pop(-1, 0)
    docs = np.zeros(embedder.dim)
    docs[list(found)] = list(found.values())
    return WeightedEmbedder(embedder.seed, embedder.dim, embedder.n, embedder.normalize, np.log((1 + total) / (1 + docs)) + 1)


def sparse_lists(df: DataFrame, embedder: HashedEmbedder, text_col: str = "text") -> DataFrame:
    """``(bucket array, weight array)``, one row a text with an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in slices(texts):
                row, bucket, weight = embedder.counted(texts[a:z])
                ends = np.append(0, np.cumsum(np.unique(row, return_counts=True)[1])).astype(np.int32)
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))),
                                       pa.ListArray.from_arrays(ends, pa.array(weight))], names=["bucket", "weight"])

    return df.select(embedder.prepared(text_col).alias("_t")).mapInArrow(run, "bucket array<int>, weight array<double>")


def _blocks(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n: int, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, dense rows) of sparse cells that are sorted by row."""
    step = max(1, CELLS // dim)
    for a in range(0, n, step):
        lo, hi = np.searchsorted(row, [a, a + step])
        dense = np.zeros((min(step, n - a), dim))
        dense[row[lo:hi] - a, bucket[lo:hi]] = weight[lo:hi]
        yield a, dense


def _pass(rows: DataFrame, w: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(R, YᵀA) of Y = A W over all rows."""
    width = w.shape[1]
    ddl = "part long, r array<double>, c array<double>"

    def add(r: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, y]), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        r, c = np.zeros((width, width)), np.zeros((width, dim))
        for b in batches:
            per = pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(per)), per)
            cells = (pc.list_flatten(b.column(i)).to_numpy(zero_copy_only=False) for i in (0, 1))
            for _, a in _blocks(row, *cells, len(per), dim):
                y = a @ w
                r, c = add(r, y), c + y.T @ a
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "r": r.ravel(), "c": c.ravel()}],
                                         schema=pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64())), ("c", pa.list_(pa.float64()))]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = np.zeros((width, width)), np.zeros((width, dim))
        for p in pdf.sort_values("part").itertuples(index=False):
            r, c = add(r, np.reshape(p.r, (width, width))), c + np.reshape(p.c, (width, dim))
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN], "r": [r.ravel()], "c": [c.ravel()]})

    parts, n = rows.mapInArrow(run, ddl), max(1, rows.rdd.getNumPartitions())
    while n > 1:
        parts, n = parts.groupBy(F.expr(f"part div {FAN}")).applyInPandas(merge, ddl), -(-n // FAN)
    merged = parts.collect()  # one row, or none of an empty corpus
    if not merged:
        return np.zeros((width, width)), np.zeros((width, dim))
    return np.reshape(merged[0]["r"], (width, width)), np.reshape(merged[0]["c"], (width, dim))


def fit_subspace(df: DataFrame, embedder: HashedEmbedder, rank: int, *, text_col: str = "text", oversample: int = 10,
                 passes: int = 3, seed: int = 0) -> np.ndarray:
    """``dim x rank`` orthonormal columns that hold most of the corpus' rows, strongest first.

    ``passes`` counts readings of the sparse rows; fewer columns come back where the corpus spans fewer."""
    dim = embedder.dim
    if not 0 < rank <= dim:
        raise ValueError(f"rank must be between 1 and {dim}: {rank}")
    if passes < 1:
        raise ValueError("at least one pass is needed")
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(dim, rank + oversample))))[0]
    scratch = Scratch(df.sparkSession, "subspace")
    rows = scratch.keep(sparse_lists(df, embedder, text_col), "rows")
    for _ in range(passes):
        r, c = _pass(rows, w, dim)
        _, s, vt = np.linalg.svd(np.linalg.pinv(r).T @ c, full_matrices=False)
        w = vt[s > s[0] * 1e-10].T if s[0] > 0 else vt[:0].T
        if not w.shape[1]:
            break
    scratch.drop(rows)
    return w[:, :rank]


def embed_dense(df: DataFrame, embedder: HashedEmbedder, subspace: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``embedding array<double>``, a text's coordinates in the subspace scaled to unit length, and
    ``kept double``, the length before that: the share of the sparse unit vector that the subspace holds.

    Both are null without an n-gram; ``embedding`` is null too where the subspace holds nothing of a text."""
    dim, rank = subspace.shape

    @F.arrow_udf("struct<embedding array<double>, kept double>")
    def project(texts: pa.Array) -> pa.Array:
        said, some = texts.to_pylist(), np.zeros(len(texts), bool)
        out = np.zeros((len(texts), rank))
        for first, z in slices(said):
            row, bucket, weight = embedder.counted(said[first:z])
            some[row + first] = True
            for a, dense in _blocks(row, bucket, weight, z - first, dim):
                out[first + a:first + a + len(dense)] = dense @ subspace
        kept = np.sqrt((out * out).sum(axis=1))
        full = kept > 1e-12
        out[full] /= kept[full][:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * rank), pa.array(out.reshape(-1)))
        vectors = pc.if_else(pa.array(some & full), lists, pa.scalar(None, lists.type))
        return pa.StructArray.from_arrays([vectors, pa.array(kept, mask=~some)], ["embedding", "kept"])

    # the struct is read twice; exploding an array of one computes it once
    got = df.select("*", F.explode(F.array(project(embedder.prepared(text_col)))).alias("_p"))
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("embedding", "kept")], "_p.embedding", "_p.kept")
