"""Exact top-k search: exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhit.llm.common import stash

OUT = "query_tag long, query_id long, vec_id long, score long"


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids ascending, row tags) and the sparse rows: (row, term, weight)."""
    ids, tags = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "tag"))
    lists = t.column("v").combine_chunks()
    lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(lens)))
    order = np.lexsort((tags, ids))
    lens = lens[order]
    take = np.repeat(start[order] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    terms, weights = take - np.repeat(start[order], lens), flat[take]
    row = np.repeat(np.arange(len(order)), lens)
    keep = weights != 0
    return ids[order], tags[order], row[keep], terms[keep], weights[keep]


def score_block(cand: pa.Table, quer: pa.Table, k: int) -> pa.Table:
    """The k best of one candidate block for each query of one query block."""
    ids, tags, row, term, weight = _vectors(cand)
    qids, qtags, qrow, qterm, qweight = _vectors(quer)
    out: list[tuple] = []
    if len(ids) and len(qids):
        by = np.argsort(term, kind="stable")  # postings: rows ascending within a term
        names, first = np.unique(term[by], return_index=True)
        ends = np.append(first[1:], len(by))
        postings = {int(t): (row[by[a:b]], weight[by[a:b]]) for t, a, b in zip(names, first, ends)}
        bound = (float(np.abs(weight).max(initial=0)) * float(np.abs(qweight).max(initial=0))
                 * max(1, len(names)))
        kind = np.int64 if bound < 2 ** 62 else object  # Python integers where 64 bits might not do
        qstart = np.searchsorted(qrow, np.arange(len(qids) + 1))
        for q, (qid, own) in enumerate(zip(qids, qtags)):
            acc = np.zeros(len(ids), kind)
            for t, w in zip(qterm[qstart[q]:qstart[q + 1]].tolist(), qweight[qstart[q]:qstart[q + 1]].tolist()):
                if t in postings:
                    pos, wc = postings[t]
                    if len(pos) == len(ids):
                        acc += w * wc.astype(kind, copy=False)
                    else:
                        acc[pos] += w * wc.astype(kind, copy=False)
            n = min(k + 1, len(ids))  # one more, as the query's own row may be among them
            floor = np.partition(acc, len(ids) - n)[len(ids) - n] if n < len(ids) else acc.min()
            best = np.flatnonzero(acc >= floor)
            best = best[tags[best] != own]
            best = best[np.argsort(-acc[best], kind="stable")][:k]  # rows stand in id order, so ties do too
            out.append((np.full(len(best), own, np.int64), np.full(len(best), qid, np.int64), ids[best].astype(np.int64), acc[best].astype(np.int64)))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("query_tag", "query_id", "vec_id", "score"), cols)))


def top_k(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          scale: int = 256, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows.

    Components become ``floor(scale * x)``; sparse query rows scatter weighted
    postings into a dense score array per candidate block, term by term; each
    block keeps its k best by partition selection and a window merges blocks.
    Both sides are cut into hashed blocks, so a task holds one candidate block
    of about ``block_rows`` and one query block, whatever the table's size.

    Null ids, null vectors and vectors with a null or non-finite component take
    no part; an empty vector scores 0 with all; vectors of unequal length share
    the terms they both have. Every row counts, also rows of a repeated id: a
    query leaves out its own row only, and each row that is a query has its k
    results. Ties go to the smaller id; fewer than k candidates give fewer rows.
    An empty table gives an empty result. Other columns are ignored. Ids are
    cast to long; ids that are none take no part. Rows are written once, with a tag each. Where a score might not
    fit a long (a squared length of 2^62 or more), a ValueError says so before any scoring."""
    usable = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
    ).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * F.lit(float(scale)) + 1, F.lit(2.0))))
    total, asked, square = usable.agg(F.count("*"), F.count_if("is_query"), longest).first()
    if square is not None and square >= 2.0 ** 62:
        raise ValueError(f"{vec_col}: a vector is too long for scores of 64 bits at scale {scale}")
    ints = stash(usable.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"),
                               "is_query", F.monotonically_increasing_id().alias("tag")), "topk")
    blocks, qblocks = max(1, math.ceil(total / block_rows)), max(1, math.ceil(asked / query_rows))
    h = F.xxhash64("tag")
    cand = ints.select("id", "tag", "v", F.pmod(h, F.lit(blocks)).cast("int").alias("cb"),
                       F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qb"))
    quer = ints.where("is_query").select("id", "tag", "v", F.pmod(h, F.lit(qblocks)).cast("int").alias("qb"),
                                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return score_block(left, right, k)

    found = cand.groupBy("cb", "qb").cogroup(quer.groupBy("cb", "qb")).applyInArrow(score, OUT)
    w = Window.partitionBy("query_tag").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
