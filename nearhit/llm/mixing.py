"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over source blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhit.llm.common import WS, stash


def n_words(text: Column) -> Column:
    """Words of a text as a long (null: 0): blanks folded to one kind, then counted between the edges."""
    flat = F.translate(text, WS, " " * len(WS))
    parts = F.filter(F.split(flat, " ", -1), lambda w: w != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long") * F.when(text.isNull(), 0).otherwise(1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, target): each source's share of all sizes, capped and reshared.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null
    last, take ``weights`` in turn. A target stops at ``max_repeats`` times
    its source's size; what lies above is shared again by weight among the
    others until none is above. The level of one weight unit only rises from
    round to round, so this is a handful of one-row aggregates; no source
    table is collected."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = stash(per.sort(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    # two-level rank: rows of earlier range partitions, then the place within the own one
    before = ordered.groupBy("part").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0))).select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.col("before") + F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    ranked = stash(ordered.withColumn("place", place).join(before, "part")
                   .select("source", "source_size", weight.cast("double").alias("weight")), "mix-weights")
    cap = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        above = (F.col("weight") * F.lit(level)) >= cap
        taken, free = ranked.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        nxt = (total - (taken or 0.0)) / free if free else level
        if nxt <= level * (1 + 1e-12):
            break
        level = nxt
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed permutation of [0, n): four Feistel rounds on a power of four, walked until below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (right + np.uint64(seed * 2654435761 + r * 40503 + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (high := out >= n).any():
        out[high] = once(out[high])
    return out.astype(np.int64)


def _from_mode(good: int, bad: int, draw: int, u: float) -> int:
    """A hypergeometric draw by inversion: chances relative to the mode's, multiplied out to both sides of it.

    Covers twenty standard deviations and the whole of a small support; what lies beyond has a chance far below a double's."""
    low, high = max(0, draw - bad), min(good, draw)
    total = good + bad
    mode = min(max((draw + 1) * (good + 1) // (total + 2), low), high)
    spread = (draw * (good / total) * (bad / total) * ((total - draw) / max(total - 1, 1))) ** 0.5
    reach = int(20 * spread) + 50
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.int64)  # step from k to k + 1
    step = (np.log((good - k).astype(float)) + np.log((draw - k).astype(float)) - np.log(k + 1.0) - np.log((bad - draw + k + 1).astype(float)))
    log = np.concatenate(([0.0], np.cumsum(step)))
    log -= log[mode - a]
    upto = np.cumsum(np.exp(log))
    return a + int(np.searchsorted(upto, u * upto[-1], side="right"))


def _hypergeometric(counts: np.ndarray, draw: int, rng: np.random.Generator) -> np.ndarray:
    """One multivariate-hypergeometric draw, source by source with the rest's total."""
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i in np.flatnonzero(counts):
        if draw == 0:
            break
        good = int(counts[i])
        # numpy's sampler ends at 1e9 a side; beyond it the same law is drawn from by inversion
        got = (int(rng.hypergeometric(good, rest - good, draw)) if max(good, rest - good) < 10 ** 9
               else _from_mode(good, rest - good, draw, rng.random()))
        out[i], rest, draw = got, rest - good, draw - got
    return out


def shard_quota(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) by source of the block draws that the tree gives to one shard.

    Walks from the root to the leaf: at each node the blocks are halved as the
    shards below it are, by a draw seeded with the node, so every task that
    walks through a node sees the same split."""
    first, have, lo, hi = np.zeros(len(quota), np.int64), quota.astype(np.int64), 0, shards
    total, done = int(quota.sum()), 0
    size = lambda a, b: b * total // shards - a * total // shards  # noqa: E731  exact shard sizes in blocks
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _hypergeometric(have, size(lo, mid), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            have, hi = left, mid
        else:
            first, have, lo = first + left, have - left, mid
    return first, have


def mix(docs: DataFrame, *, size: Column, doc_id: str = "doc_id", source: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, block_size: int = 8192, shards: int | None = None, shard_size: int = 1_000_000,
        rows_per_bucket: int = 50_000, seed: int = 17, tag: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their targets, pieces of the mix).

    Documents: doc_id, tag, source, size, source_size, target and start (the
    place in the source's seeded order). Pieces: doc_id, tag, source, start,
    epoch, length (size units taken, from the document's start), block, shard,
    place (random order within the shard). ``tag`` is any value that callers
    want to find rows again by, such as a hash of the text.

    A source whose target is q times its size and a rest r gives q whole
    epochs and, of one more, the first r units in its seeded order; only the
    document at that end is cut, so the taken sum is the rounded target and
    no document is taken more than ``max_repeats`` times over. Each epoch is cut into blocks of
    about ``block_size`` units of whole documents; ``shard_quota`` splits the
    exact block quotas of all sources among the shards and each shard draws
    its own disjoint range of the permuted blocks. There is a shard for every
    ``shard_size`` units, 16 at least, unless ``shards`` says how many.

    Documents are ordered within (source, hash bucket) windows and the
    buckets' sums added up, so a source with most of the rows is many tasks.
    Null source: a source of its own, last. Size 0 (empty or null text):
    taken 0 and no piece. Rows with equal ids are separate documents. An
    empty table gives empty results. The source table itself (one row a
    source) and its quotas are held by a task as arrays; documents are not."""
    rows = stash(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                             size.cast("long").alias("size"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
                 .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "tag")), "mix-rows")
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    buckets = max(64, count // rows_per_bucket)
    shards = shards or max(16, math.ceil((total or 0) / shard_size))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    narrow = rows.select("source", "bucket", "size")
    per_bucket = stash(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    targets = source_targets(per_bucket, weights, max_repeats)
    base = per_bucket.select("source", "bucket", (F.sum("size").over(
        Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("base"))
    info = base.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        "b.source", "b.bucket", "b.base", "t.source_size", "t.target")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tag")
    placed = (rows.withColumn("within", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
              .alias("r").join(info.alias("i"), F.expr("r.source <=> i.source AND r.bucket = i.bucket"))
              .select("r.*", "i.source_size", "i.target", (F.col("r.within") + F.col("i.base")).alias("start"))
              .drop("within", "bucket"))

    # exact block quotas: whole epochs, and the blocks that the last one touches
    whole = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(whole / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = whole - full * F.col("source_size")
    blocks_of = lambda n: F.ceil(n / F.lit(block_size)).cast("long")
    quotas = targets.select("source", full.alias("full"), rest.alias("rest"),
                            blocks_of(F.col("source_size")).alias("blocks"),
                            (full * blocks_of(F.col("source_size")) + blocks_of(rest)).alias("quota"))
    pieces = (placed.withColumn("full", full).withColumn("rest", rest)
              .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
              .withColumn("length", F.when(F.col("epoch") < F.col("full"), F.col("size")).otherwise(
                  F.least(F.col("size"), F.greatest(F.col("rest") - F.col("start"), F.lit(0)))).cast("long"))
              .where("length > 0")
              .withColumn("draw", F.col("epoch") * blocks_of(F.col("source_size"))
                          + F.floor(F.col("start") / F.lit(block_size))))

    def deal(batches):
        for pdf in batches:
            for table, shard in zip(pdf["table"], pdf["shard"]):
                table = sorted(table, key=lambda r: (r["source"] is None, r["source"] or ""))
                quota = np.array([r["quota"] for r in table], np.int64)
                first, count = shard_quota(quota, shards, int(shard), seed)
                for i in np.flatnonzero(count):
                    for a in range(0, int(count[i]), 100_000):  # a shard's blocks of one source, in steps
                        index = first[i] + np.arange(a, min(a + 100_000, int(count[i])))
                        yield pd.DataFrame({"source": table[i]["source"], "shard": shard,
                                            "draw": _permuted(index, int(quota[i]), seed + int(i))})

    one = quotas.where("quota > 0").agg(F.collect_list(F.struct("source", "quota")).alias("table"))
    leaves = docs.sparkSession.range(0, shards, 1, min(shards, 256)).withColumnRenamed("id", "shard").join(F.broadcast(one))
    drawn = leaves.mapInPandas(deal, "source string, shard long, draw long")
    placed_pieces = (pieces.alias("p").join(drawn.alias("d"), F.expr("p.source <=> d.source AND p.draw = d.draw"))
                     .select("p.doc_id", "p.tag", "p.source", "p.start", "p.size", "p.epoch", "p.length",
                             F.col("p.draw").alias("block"), "d.shard",
                             F.xxhash64(F.lit(seed + 1), "p.doc_id", "p.epoch", "p.h").alias("place")))
    return placed, placed_pieces


def taken(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per document of ``mix``: doc_id, size, source_size, target, taken (0 without pieces)."""
    got = pieces.groupBy("source", "start", "doc_id", "size").agg(F.sum("length").alias("taken"))
    on = "d.source <=> g.source AND d.start = g.start AND d.doc_id <=> g.doc_id AND d.size = g.size"
    return docs.alias("d").join(got.alias("g"), F.expr(on), "left").select(
        "d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken"))
