"""Toxicity (op4) and language ID (op5): exact parts against brute force, and held-out accuracy."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from nearhit.llm import langid, toxicity
from nearhit.llm.queries import op4_toxicity, op5_language

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    emission, move, length = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 2, 1])
    post, pairs = langid.forward_backward(emission, length, move)
    want_pairs = np.zeros((3, 3))
    for c, n in enumerate(length):
        total, marg, both = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=n):
            w = np.exp(sum(emission[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                marg[t, y] += w
            for a, b in zip(path, path[1:]):
                both[a, b] += w
        assert np.allclose(post[c, :n], marg / total)
        want_pairs += both / total
    assert np.allclose(pairs, want_pairs)


def test_word_features_touch_only_their_word():
    raw, start, end, per = langid.split_words([b"ab cd", b"", b"ab. x1y"])
    assert [raw[a:b].tobytes() for a, b in zip(start, end)] == [b"ab", b"cd", b"ab", b"x", b"y"] and per.tolist() == [2, 0, 3]
    feature, word, of = langid.features(raw, start, end, 1 << 30)
    assert of[0] == of[2] and len(set(of)) == 4
    alone = langid.features(*langid.split_words([b"cd"])[:3], 1 << 30)[0]
    assert sorted(feature[word == of[1]]) == sorted(alone)
    assert len(alone) == 1 + 2 + 3 + 2 + 1  # whole, 1-grams, 2-grams with edges, 3-grams, 4-gram


def test_code_switched_words_are_labelled():
    rng = np.random.default_rng(2)
    pick = lambda parts, n: " ".join("".join(rng.choice(parts, 3)) for _ in range(n))
    a, b = ["tha", "ing", "oer"], ["ciö", "ñue", "zzo"]
    texts, langs = [pick(a, 60) for _ in range(20)] + [pick(b, 60) for _ in range(20)], ["a"] * 20 + ["b"] * 20
    model = langid.train(texts, langs, space=1 << 12, epochs=4, span=12, spans=4, seed=1)
    post, _, _ = langid.label_words([pick(a, 15) + " " + pick(b, 15)], model)
    assert (post[:15, 0] > 0.5).all() and (post[15:, 1] > 0.5).all()


def test_language_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op5_language(spark, SF).join(lang, "doc_id").toPandas()
    assert got["score"].between(0, 1).all() and len(got) == 1000
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97


def test_language_edge_cases(spark):
    rows = [(1, "the thing", "en"), (2, "der ding", "de"), (3, None, "en"), (4, "", "de"), (5, "12 -- 34", "en"), (6, "²①", None),
            (None, "the thing", None), (1, "the thing", "en"), (7, "the " * 5000, None), (8, "the", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.predict(df, langid.fit(df), chars=1000).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(got) == len(rows) and all(by[i] == [("und", 0.0)] for i in (3, 4, 5, 6))
    assert by[1][0] == by[1][1] == by[None][0] and by[1][0][0] == "en" and by[7][0][0] == "en"
    none = langid.fit(df.where("lang IS NULL"))
    assert none["labels"] == [] and {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), none).count() == 0


def test_composed_transducers_equal_a_plain_scan():
    rng = np.random.default_rng(3)
    for _ in range(200):
        classes = rng.integers(0, 6, rng.integers(1, 30)).tolist()
        for k, marks in enumerate(toxicity.AHEAD.run(classes)):
            want = set()
            for opener, reach, mark in ((toxicity.NEGATIONS, 4, "negated"), (toxicity.REPORTS, 40, "reported"), (toxicity.TARGETS, 6, "targeted")):
                if opener in classes[max(0, k - reach + 1):k + 1]:
                    want.add(mark)
            assert set(marks) == want


def test_clauses_not_words_are_scored():
    g = toxicity.Grammar({"fool": 4.0}, {"morr": 2.0})
    got = list(g.clauses("You fool! He said the fool left. This is not a fool, but morrik. Nothing here. I will kill you; kill time"))
    assert [{m: v for m, v in c.items() if v} for c in got] == [
        {"targeted": 4.0}, {"reported": 4.0}, {"negated": 4.0}, {"plain": 2.0}, {"threat": 1.0}, {}]


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    got = op4_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    caught = held[held.predicted == 1]
    # a seventh of the toxic labels of this table are noise on texts without any insult
    assert (caught.y == 1).mean() > 0.95 and (held[held.y == 1].predicted == 1).mean() > 0.8
    assert got["score"].between(0, 1).all()


def test_toxicity_edge_cases(spark):
    docs = [(i, ("you fool " if i % 4 == 0 else "kind word ") * 3, 0) for i in range(200)] + [(900, None, 0), (901, "", 0), (None, "you fool", 0), (0, "you fool " * 3, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    rows = [(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None), (4, 1), (4, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r.score for r in got}
    assert by[4] > 0.9 and by[5] < 0.1 and by[None] > 0.9 and by[900] == by[901] < 0.1
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), toxicity.fit(df, labels.limit(0))).count() == 0
