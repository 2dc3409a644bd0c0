"""Mixing (op9) and packing (op8): exact sums, exact round trips."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhit.llm import mixing, packing
from nearhit.llm.queries import tokenizer_path


def level_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; excess over the cap reshared among the rest until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(cap * sizes[s]) for s in over}


def mix_docs(spark, n=400):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 900]))), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(n)]
    rows += [(900, None, "a"), (901, "", "only-empty"), (902, "x y", "tiny"), (None, "one two", "b"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame([(i, t, s, 1.5, "q") for i, t, s in rows], "doc_id long, text string, source string, target double, start string").repartition(5)


def test_mix_meets_targets(spark):
    rows, df = mix_docs(spark)
    docs, pieces = mixing.mix(df, size=mixing.n_words(F.col("text")), block_size=500, shards=7, rows_per_bucket=50)
    got = mixing.taken(docs, pieces).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = level_targets(sizes)
    source_of = {}
    for i, _, s in rows:
        source_of.setdefault(i, s)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.taken(*mixing.mix(df, size=mixing.n_words(F.col("text")), block_size=500, shards=7, rows_per_bucket=50)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_every_block_goes_to_one_shard(spark):
    _, df = mix_docs(spark)
    _, pieces = mixing.mix(df, size=mixing.n_words(F.col("text")), block_size=500, shards=7, rows_per_bucket=50)
    rows = pieces.select("source", "block", "shard").distinct().collect()
    assert len({(r.source, r.block) for r in rows}) == len(rows)
    assert len({r.shard for r in rows}) == 7


def test_tree_hands_out_exact_quotas():
    quota = np.array([100, 0, 7, 3000, 1])
    got = [mixing.shard_quota(quota, 13, s, 5) for s in range(13)]
    assert np.array_equal(sum(c for _, c in got), quota)
    total = int(quota.sum())
    assert [int(c.sum()) for _, c in got] == [(s + 1) * total // 13 - s * total // 13 for s in range(13)]
    for i in range(len(quota)):  # disjoint ranges in a row
        spans = sorted((int(f[i]), int(c[i])) for f, c in got if c[i])
        assert [a for a, _ in spans] == np.concatenate(([0], np.cumsum([n for _, n in spans])[:-1])).astype(int).tolist() if spans else True
    assert np.array_equal(mixing.shard_quota(quota, 1, 0, 5)[1], quota)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing._permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_mix_of_nothing(spark):
    _, df = mix_docs(spark)
    for frame in (df.limit(0), df.where("doc_id = 901")):
        assert [r["taken"] for r in mixing.taken(*mixing.mix(frame, size=mixing.n_words(F.col("text")))).collect()] == [0] * frame.count()


def check_packing(rows, ids_of, max_tokens, max_segments, max_loss):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r.doc_id]
        assert zlib.crc32(ids[r.start:r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 and r.length > 0
        assert r.doc_tokens == len(ids)
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append((r.start, r.length))
    for i, ids in ids_of.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens and len(seq) <= max_segments and sum(r.loss_tokens for r in seq) <= max_loss
        assert at == max_tokens or at & (at - 1) == 0  # no padding


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer
    rng = random.Random(6)
    words = ["The", "quick,", "naïve", "don't", "<|endoftext|>", "x" * 40, "42.", "A--B", "H̱", "…"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 300, 3000]))) for i in range(80)}
    texts |= {100: None, 101: "", 102: "\n\t "}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, start int, length int").repartition(3)
    rows = packing.pack(df, tokenizer_path=tokenizer_path(), max_tokens=512, max_segments=8, max_loss=512).collect()
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in texts.items()}
    check_packing(rows, ids, 512, 8, 512)


def test_pack_limits_loss_tokens(spark):
    from tokenizers import Tokenizer
    rng = random.Random(7)
    rows = [(i, "ask " * rng.randint(0, 200), "answer it " * rng.randint(0, 120)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, answer string").coalesce(1)
    got = packing.pack(df, tokenizer_path=tokenizer_path(), parts=(("prompt", False), ("answer", True)), max_tokens=512,
                       max_segments=6, max_loss=100).collect()
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(t.encode(p, add_special_tokens=False).ids + t.encode(a, add_special_tokens=False).ids + [2]) for i, p, a in rows}
    check_packing(got, ids, 512, 6, 100)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, tokenizer_path=tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 6 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(df.limit(0), tokenizer_path=tokenizer_path()).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    t, e = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path(), cache_words=500)
    rng = random.Random(1)
    parts = list("abAZ.,'!-<>|&$ \n\t09éÉßñ×÷ı̈İǅſ…—“\x1c\x85\xa0中😀") + ["'s", "'ll", "<|endoftext|>", "<|", "a.'s", "--'s", "≠", "H̱"]
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(100)]
        for text, ids in zip(texts, e.encode([x.encode() for x in texts])):
            assert t.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_draws_by_inversion_follow_the_same_law():
    rng = np.random.default_rng(3)
    for good, bad, draw in ((5, 7, 4), (40, 3, 20), (1, 1, 1), (3000, 50, 2990), (10, 0, 4)):
        low, high = max(0, draw - bad), min(good, draw)
        chance = np.array([math.comb(good, k) * math.comb(bad, draw - k) / math.comb(good + bad, draw) for k in range(low, high + 1)])
        upto = np.cumsum(chance)
        us = rng.random(400)
        assert [mixing._from_mode(good, bad, draw, u) for u in us] == [low + int(np.searchsorted(upto, u * upto[-1], side="right")) for u in us]


def test_draws_above_a_billion_blocks_spread_as_they_should():
    good, bad, draw = 2 * 10 ** 9, 3 * 10 ** 9, 10 ** 6
    got = np.array([mixing._hypergeometric(np.array([good, bad]), draw, np.random.default_rng(s))[0] for s in range(300)])
    mean, spread = draw * 0.4, math.sqrt(draw * 0.4 * 0.6 * (1 - draw / (good + bad)))
    assert len(set(got.tolist())) > 100 and abs(got.mean() - mean) < 4 * spread / math.sqrt(300)
    assert 0.85 * spread < got.std() < 1.15 * spread
    huge = np.array([10 ** 10, 5 * 10 ** 9, 7])
    out = mixing._hypergeometric(huge, 7 * 10 ** 9, np.random.default_rng(1))
    assert out.sum() == 7 * 10 ** 9 and (out <= huge).all()
