"""Word windows (op3) and byte strings (op6) against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from nearhit.llm import substrings, suffix

SCHEMA = "doc_id long, text string, m string, tag long, marks int"  # clashing names on purpose


def corpus():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(400)] + ["é", "naïve,", "x" * 50]
    para = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(60):
        own = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))
        parts = [own] + [rng.choice(para) for _ in range(rng.randint(0, 2))] + [" ".join(rng.choice(vocab) for _ in range(20))]
        rng.shuffle(parts)
        docs.append((i, rng.choice(["\n", "  ", " \t"]).join(parts)))
    docs += [(100, ""), (101, None), (102, "one two"), (103, "ab " * 300), (104, "z" * 900), (105, "z" * 450 + "y" * 10),
             (None, para[0]), (106, "  \n "), (107, "lead " + para[1] + " tail"), (108, docs[0][1]), (108, docs[0][1]), (108, para[2])]
    for i in range(30):  # many different strings around one passage
        docs.append((200 + i, f"a{i} " * 3 + para[3] + f" b{i}" * 40))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], SCHEMA).repartition(5)


@pytest.mark.parametrize("limits", [{}, {"bucket_units": 300, "collapse": 50, "lot": 1000}])
def test_words_equal_brute_force(spark, limits):
    docs = corpus()
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in
                 substrings.remove_repeats(frame(spark, docs), width=12, **limits).collect())
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[i:i + 12]) for w in words for i in range(len(w) - 11))
    want = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - 11):
            if seen[tuple(w[k:k + 12])] > 1:
                gone.update(range(k, k + 12))
        want.append((i or -1, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert got == sorted(want)


@pytest.mark.parametrize("limits", [{}, {"bucket_units": 900, "collapse": 50, "lot": 2000}])
def test_bytes_equal_brute_force(spark, limits):
    docs = corpus()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in
                 suffix.remove_repeats(frame(spark, docs), width=70, **limits).collect())
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i:i + 70] for b in raw for i in range(len(b) - 69))
    want = []
    for (i, _), b in zip(docs, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 69):
            if seen[b[k:k + 70]] > 1:
                gone[k:k + 70] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i or -1, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    assert got == sorted(want)


def test_long_documents_are_cut_in_pieces(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randint(0, 10 ** 6)) for _ in range(3000))
    units = substrings.Words(12, piece=100)
    got = np.concatenate([f for _, _, f, _, _ in units.super_kmers(long.encode())])
    count = np.concatenate([n for _, _, _, n, _ in units.super_kmers(long.encode())])
    assert np.array_equal(got[1:], (got + count)[:-1]) and got[-1] + count[-1] == 3000 - 11


def test_run_index_is_a_transform_of_the_text():
    index = suffix.RunIndex([b"banana bandana " * 3, b"banana", b"", b"a" * 40])
    sa = suffix.suffix_array(index.text, index.key)
    n = len(index.text)
    assert sorted(sa) == list(range(n))
    assert all(index.text[a:].tolist() < index.text[b:].tolist() for a, b in zip(sa, sa[1:]))
    assert np.array_equal(np.repeat(index.head, index.length), np.where(sa > 0, index.text[sa - 1], 0))


def test_empty_tables(spark):
    assert substrings.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert suffix.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0
