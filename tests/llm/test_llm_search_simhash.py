"""Exact top-k (op10) and SimHash near-dedup (op7) against brute force."""

import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearhit.llm import simhash, topk
from nearhit.llm.common import components


def vectors(n=300, dim=9, seed=1):
    rng = random.Random(seed)
    rows = [(i, [float(rng.choice([0.0, 0.0, rng.uniform(-2, 2)])) for _ in range(dim)]) for i in range(n)]
    rows[7] = (7, rows[6][1])  # ties
    rows[8] = (8, rows[6][1])
    rows += [(None, [1.0] * dim), (400, None), (401, [None] * dim), (402, [math.nan] * dim), (403, [math.inf] * dim),
             (404, []), (405, [1.0, 2.0]), (3, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (50, rows[9][1]), (50, rows[9][1]), (450, [0.0] * dim)]
    return rows


def brute_top(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (q, w) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, (i, v) in enumerate(usable) if j != r)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 40, "query_rows": 2}])
def test_top_k_equals_brute_force(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **blocks).collect())
    assert got == brute_top(rows)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_of_a_repeated_id_are_candidates(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [3.0]), (50, [1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert got == [(1, 196608), (1, 65536)]


def test_scores_beyond_a_double_are_exact_or_refused(spark):
    big = [(0, [float(2 ** 20)] * 3), (1, [float(2 ** 20)] * 3), (2, [float(2 ** 20), float(2 ** 20), 2.0 ** 20 + 2 ** -8])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 3 * 2 ** 56 + 2 ** 28), (1, 3 * 2 ** 56)]
    with pytest.raises(ValueError):
        topk.top_k(df.union(spark.createDataFrame([(9, [1e300])], df.schema)), F.col("vec_id") == 0)


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(keys, pairs):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(50)] + ["É", "Straße", "the", "The"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(300):  # near copies of long texts
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "edited"
        docs.append((1000 + i, " ".join(w)))
    docs += [(2000, ""), (2001, None), (1999, " \t\n"), (2002, "one"), (2003, "ONE"), (2004, "one two"), (None, base[0]), (5, base[5]), (5, base[5])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, root string, fp int").repartition(6)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(docs)
    fps = sorted({plain_fingerprint(t) for _, t in docs})
    arr = np.array(fps, np.uint64)
    pairs = [(fps[i], fps[i + 1 + int(j)]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3)]
    root = classes(fps, pairs)
    low = {}
    for i, t in docs:
        if i is not None:
            r = root[plain_fingerprint(t)]
            low[r] = min(low.get(r, i), i)
    want = sorted(((i if i is not None else -1), f"{plain_fingerprint(t):016x}", low[root[plain_fingerprint(t)]]) for i, t in docs)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("short", [2, 16])
def test_links_find_every_pair_at_three_bits(spark, short):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    fps = set(int(s) for s in seeds)
    for s in seeds:
        for _ in range(30):
            x = int(s)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    # one crowded list: all values of the low byte under one prefix
    fps |= {(0xABCDEF << 40) | v for v in range(0, 256)}
    fps = sorted(fps)
    signed = [struct.unpack("<q", struct.pack("<Q", f))[0] for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, 3, short).collect()]
    assert all((int(a) ^ int(b) if (a < 0) == (b < 0) else (a ^ b) & (2 ** 64 - 1)).bit_count() <= 3 for a, b in got)
    arr = np.array(fps, np.uint64)
    pairs = [(signed[i], signed[i + 1 + int(j)]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3)]

    def groups(p):
        by = {}
        for k, r in classes(signed, p).items():
            by.setdefault(r, set()).add(k)
        return sorted(map(sorted, by.values()))
    assert groups(got) == groups(pairs)


def test_breadth_first_by_flips_equals_by_scan():
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 12, 900), rng.integers(0, 1 << 40, 30)])).astype(np.int64)
    few = simhash._closer(values[values < 1 << 12], 2)  # 79 flips of 12 bits, fewer than values
    scan = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1:] if a < 1 << 12 and b < 1 << 12 and (int(a) ^ int(b)).bit_count() <= 2]
    keys = [int(v) for v in values if v < 1 << 12]
    assert len({r for r in classes(keys, few).values()}) == len({r for r in classes(keys, scan).values()})
    assert len(few) < len(keys)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 301), (301, 300), (500, 500)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(30)} | {301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
