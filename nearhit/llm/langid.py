"""Language ID of words in code-switched text: a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhit.llm.superkmer import mixed, span_hash

LETTER = regex.compile(r"\p{L}")
CHAIN = 32  # words of one chain
GRAMS = (1, 2, 3, 4)
_IN_WORD = np.zeros(256, bool)  # ASCII letters and all bytes of longer characters
_IN_WORD[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, words of each text) of the words of all texts."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    inside = np.concatenate(([False], _IN_WORD[raw]))
    start = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    stop = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, stop)
    return raw, start, end, np.diff(np.concatenate(([0], upto)))


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word, word of each given place): hashed features of the distinct words, and which one each place has.

    Affixes are grams that touch a word's edge, n-grams those inside, and the whole word is the lexicon feature."""
    whole = span_hash(_SPREAD[raw], start, end)
    distinct, at, of = np.unique(whole, return_index=True, return_inverse=True)
    length = end[at] - start[at]
    offset = np.concatenate(([0], np.cumsum(length + 1)))
    buffer = np.zeros(offset[-1] + 1, np.uint64)  # 0 word 0 word 0
    take = np.repeat(start[at] - offset[:-1], length) + np.arange(length.sum()) + np.repeat(np.arange(len(at)), length)
    buffer[np.repeat(offset[:-1] + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())] = raw[take]
    word_of = np.cumsum(buffer == 0) - 1
    found, words = [distinct], [np.arange(len(at))]
    for n in GRAMS:
        size = len(buffer) - n + 1
        if size <= 0:
            continue
        code, inner = np.full(size, n, np.uint64), np.ones(size, bool)
        for k in range(n):
            part = buffer[k:k + size]
            code = (code << np.uint64(8)) | part
            inner &= (part != 0) if 0 < k < n - 1 or n == 1 else True
        keep = np.flatnonzero(inner & (word_of[:size] < len(at)))
        if n > 1:
            keep = keep[(buffer[keep] != 0) | (buffer[keep + 1] != 0)]
        found.append(mixed(code[keep]))
        words.append(word_of[keep])
    feature, word = np.concatenate(found) % np.uint64(space), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return feature[order].astype(np.int64), word[order], of


_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64))


def chains(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(chain, place in it) of each word and the number of chains; a chain never crosses texts."""
    place = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    many = -(-per_text // CHAIN)
    return np.repeat(np.cumsum(many) - many, per_text) + place // CHAIN, place % CHAIN, int(many.sum())


def forward_backward(emission: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chain, place, label) and expected transitions (label, label); log potentials in, all chains at once."""
    many, size, labels = emission.shape
    local = np.exp(emission - emission.max(axis=2, keepdims=True))
    step = np.exp(move - move.max())
    on = np.arange(size)[None, :] < length[:, None]
    ahead, behind = np.empty((many, size, labels)), np.ones((many, size, labels))
    ahead[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        now = (ahead[:, t - 1] @ step) * local[:, t]
        ahead[:, t] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(size - 2, -1, -1):
        right = local[:, t + 1] * behind[:, t + 1]
        back = right @ step.T
        back /= back.sum(axis=1, keepdims=True)
        live = on[:, t + 1]
        joint = ahead[live, t][:, :, None] * step[None] * right[live][:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        behind[:, t] = np.where(live[:, None], back, 1.0)
    post = ahead * behind
    return post / post.sum(axis=2, keepdims=True), pairs


def train(texts: list[str], langs: list[str], *, space: int, epochs: int, span: int, spans: int, seed: int) -> dict:
    """Weights from labelled texts: chains of two spans of words of random texts, so that languages switch inside.

    Every text gives up to ``spans`` spans of ``span`` words at random places. Adagrad on the chains' log likelihood."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    raw, start, end, per = split_words([t.lower().encode() for t in texts])
    first = np.cumsum(per) - per
    picked = [(int(first[i] + a), int(min(span, per[i] - a)), labels.index(langs[i])) for i in range(len(texts)) if per[i]
              for a in (rng.integers(0, max(1, per[i] - span + 1), min(spans, -(-int(per[i]) // span))))]
    feature, word, of = features(raw, start, end, space)
    bounds = np.searchsorted(word, np.arange(word[-1] + 2)) if len(word) else np.zeros(1, np.int64)
    weight, move = np.zeros((space, len(labels))), np.zeros((len(labels), len(labels)))
    seen_w, seen_m = np.full(weight.shape, 1e-2), np.full(move.shape, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(picked))
        for a in range(0, len(order), 128):
            lot = [picked[i] for i in order[a:a + 128]]
            pairs = [lot[i:i + 2] for i in range(0, len(lot), 2)]
            size = max(sum(n for _, n, _ in p) for p in pairs)
            at, gold = np.zeros((len(pairs), size), np.int64), np.zeros((len(pairs), size), np.int64)
            length = np.zeros(len(pairs), np.int64)
            for r, p in enumerate(pairs):
                for s, n, y in p:
                    at[r, length[r]:length[r] + n], gold[r, length[r]:length[r] + n] = np.arange(s, s + n), y
                    length[r] += n
            on = np.arange(size)[None, :] < length[:, None]
            rows = of[at]
            used = np.unique(rows[on])
            count = bounds[used + 1] - bounds[used]
            take = np.repeat(bounds[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            f, w = feature[take], np.repeat(np.arange(len(used)), count)
            score = np.stack([np.bincount(w, weight[f, y], len(used)) for y in range(len(labels))], axis=1)
            local = np.where(on[:, :, None], score[np.minimum(np.searchsorted(used, rows), len(used) - 1)], 0.0)
            post, expected = forward_backward(local, length, move)
            both = on[:, 1:]
            observed = np.zeros_like(move)
            np.add.at(observed, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            slope = post.copy()
            np.put_along_axis(slope, gold[:, :, None], np.take_along_axis(post, gold[:, :, None], 2) - 1, 2)
            where = np.searchsorted(used, rows[on])
            by_word = np.stack([np.bincount(where, slope[:, :, y][on], len(used)) for y in range(len(labels))], axis=1)
            for y in range(len(labels)):
                grad = np.bincount(f, by_word[w, y], space)
                hit = np.flatnonzero(grad)
                g = grad[hit] + 1e-4 * weight[hit, y]
                seen_w[hit, y] += g * g
                weight[hit, y] -= 0.2 * g / np.sqrt(seen_w[hit, y])
            g = expected - observed + 1e-3 * move
            seen_m += g * g
            move -= 0.1 * g / np.sqrt(seen_m)
    return {"labels": labels, "weight": weight.astype(np.float32), "move": move.astype(np.float32)}


def label_words(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(posteriors of all words, words of each text, (buffer, starts, ends)); forward-backward over chains of words."""
    raw, start, end, per = split_words([t.lower().encode() for t in texts])
    labels, weight = len(model["labels"]), model["weight"]
    if not len(start):
        return np.zeros((0, labels)), per, [raw, start, end]
    feature, word, of = features(raw, start, end, len(weight))
    score = np.add.reduceat(weight[feature], np.searchsorted(word, np.arange(word[-1] + 1)), axis=0)
    chain, place, many = chains(per)
    length = np.bincount(chain, minlength=many)
    out = np.empty((len(of), labels))
    for a in range(0, many, 1 << 14):  # bounded lots of chains
        inside = slice(*np.searchsorted(chain, (a, a + (1 << 14))))
        lot = min(1 << 14, many - a)
        local = np.zeros((lot, CHAIN, labels))
        local[chain[inside] - a, place[inside]] = score[of[inside]]
        post, _ = forward_backward(local, length[a:a + lot], model["move"].astype(np.float64))
        out[inside] = post[chain[inside] - a, place[inside]]
    return out, per, [raw, start, end]


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None,
        rows_per_lang: int = 300, space: int = 1 << 16, epochs: int = 4, span: int = 16, spans: int = 6, seed: int = 7) -> dict:
    """A model from the rows where ``use`` holds and lang is not null.

    At most ``rows_per_lang`` rows a language, those of the smallest hashed
    ids, are read for it: ids are ranked first, on narrow rows, and the texts
    of the chosen ones fetched by a join with that bounded list, one text (the smallest) for each id and language. One task
    trains; the model has ``space`` times the languages weights. No labelled row: no label."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"),
                       F.col(f"`{text}`").cast("string").alias("text"), (F.lit(True) if use is None else use).alias("use"))
    rows = rows.where("use AND lang IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    chosen = rows.select("id", "lang").withColumn("r", rank).where(F.col("r") <= rows_per_lang).select("id", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["text"]).sort_values(["lang", "id", "text"])
        if not len(frame):
            return pd.DataFrame({"labels": [], "weight": [], "move": []})
        model = train(frame["text"].tolist(), frame["lang"].tolist(), space=space, epochs=epochs, span=span, spans=spans, seed=seed)
        return pd.DataFrame({"labels": [model["labels"]], "weight": [model["weight"].tobytes()], "move": [model["move"].tobytes()]})

    got = sample.groupBy("id", "lang").agg(F.min("text").alias("text")).groupBy().applyInPandas(
        one, "labels array<string>, weight binary, move binary").collect()
    if not got:
        return {"labels": [], "weight": np.zeros((space, 0), np.float32), "move": np.zeros((0, 0), np.float32)}
    labels = list(got[0]["labels"])
    return {"labels": labels, "weight": np.frombuffer(got[0]["weight"], np.float32).reshape(space, len(labels)),
            "move": np.frombuffer(got[0]["move"], np.float32).reshape(len(labels), len(labels))}


def predict(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text", chars: int = 1 << 21) -> DataFrame:
    """(doc_id, lang_pred, score): the language with the largest mean posterior over the words of the whole text.

    Words are labelled by forward-backward in chains of at most 32. Null
    texts and texts without a letter: ``und`` and 0; ties go to the language
    that sorts first. Row by row, so repeated rows get equal results; other columns are ignored. ``chars`` bounds
    the text that a task works on at once; a longer text is cut between words, and its parts' posteriors added up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # space x languages floats, whatever the input

    def parts(text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > chars:
            cut = text.rfind(" ", at, at + chars)
            cut = cut if cut > at else at + chars
            out.append(text[at:cut])
            at = cut
        return out + [text[at:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total, words = np.zeros((len(texts), len(model["labels"]))), np.zeros(len(texts))
            lot: list[tuple[int, str]] = []
            held = 0

            def settle() -> None:
                post, per, _ = label_words([t for _, t in lot], model)
                at = np.concatenate(([0], np.cumsum(per)))
                for (i, _), a, b in zip(lot, at[:-1], at[1:]):
                    total[i] += post[a:b].sum(axis=0)
                    words[i] += b - a

            if model["labels"]:
                for i, t in enumerate(texts):
                    if t and LETTER.search(t):
                        for p in parts(t):
                            lot.append((i, p))
                            held += len(p)
                            if held > chars:
                                settle()
                                lot, held = [], 0
                if lot:
                    settle()
            known = words > 0
            best = total.argmax(axis=1) if model["labels"] else np.zeros(len(texts), int)
            names = [model["labels"][b] if k else "und" for b, k in zip(best, known)]
            share = np.where(known, total.max(axis=1, initial=0.0) / np.maximum(words, 1), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(share, 0.0, 1.0))],
                                  names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
