"""op12 against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from nearhit.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def counted(rows, every=199):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=199, least=6, at_least=5):
    words = {w: k for w, k in counted(rows, every).items() if len(w) >= least and k >= at_least}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out = {}
    for w, k in words.items():
        found = [v for s in (-1, 0, 1) for v in by_size.get(len(w) + s, []) if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 5 * k else None, k, len(found))
    rows = []
    for w, (form, k, found) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, k, found, out[form][1] if form else None))
    return sorted(rows)


def results(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def noisy(seed, count, letters="abéÿ", sizes=(5, 12)):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(40)]
    words = []
    for _ in range(count):
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])
        words += [w] * rng.choice([1, 2, 5, 30, 180])
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("every", [3, 199])
def test_equals_brute_force(spark, every):
    words = noisy(every, 600)
    rows = [(i if i % 9 else None, ". ".join(words[i * 200:(i + 1) * 200])) for i in range(len(words) // 200 + 1)]
    rows += [(1, None), (2, ""), (3, "Ünlike UNLIKE × ÷÷÷÷÷÷ " * 9), (3, "Ünlike UNLIKE × ÷÷÷÷÷÷ " * 9)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, word string").repartition(3)
    assert results(spelling.variants(docs, every=every)) == brute(rows, every)


def test_long_words_and_repeated_letters(spark):
    long = "ab" * 90
    words = [long, long[:100] + "x" + long[100:], long[:20] + long[21:], long[:150] + "y" + long[151:], *("a" * k for k in range(6, 90)), "a" * 40 + "b" + "a" * 30]
    words += [long[:-1] + c for c in "cdefgh"] + [c + long[1:] for c in "cdefgh"]
    rows = [(1, " ".join(w for w in words for _ in range(5 + 30 * (len(w) % 2))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(spelling.variants(docs)) == brute(rows)


def test_crc_of_spans():
    raw = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    start, end = np.array([0, 5, 5, 10, 100]), np.array([0, 6, 9, 1000, 164])
    got = spelling.crc_of(raw, start, end, np.array([zlib.crc32(b"12:")] * 5, np.uint32))
    assert got.tolist() == [zlib.crc32(b"12:" + raw[a:b].tobytes()) for a, b in zip(start, end)]


def test_runs_end_with_their_text():
    got = spelling.runs(pa.array(["abcdef", "ghijkl", "", "é", "éééééé1Éééééé"]), [b"1:"] * 5, 10**9, 6)
    assert got.to_pylist() == ["abcdef", "ghijkl", "éééééé", "Éééééé"]


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
