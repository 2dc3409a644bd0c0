"""Spelling variants: words one edit apart, found by walking a distributed trie level by level."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhit.llm.common import stash, utf8
from nearhit.llm.superkmer import mixed, span_hash

AHEAD = 32  # characters of a word that a state carries; a longer rest is fetched when they are used up


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def crc_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from the crc32 of what stands before it. All spans advance byte by byte together."""
    order = np.argsort(start - end, kind="stable")  # longest first
    at, size, state = start[order], (end - start)[order], ~state[order].astype(np.uint32)
    for j in range(min(int(size.max(initial=0)), 64)):
        n = np.searchsorted(-size, -j, side="left")  # spans with more than j bytes
        state[:n] = _CRC[(state[:n] ^ raw[at[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    state = ~state
    for k in range(int(np.searchsorted(-size, -64, side="left"))):
        state[k] = zlib.crc32(raw[at[k] + 64:at[k] + size[k]].tobytes(), int(state[k]))
    out = np.empty(len(order), np.uint32)
    out[order] = state
    return out


def runs(texts: pa.Array, prefixes: list[bytes], every: int, least: int) -> pa.Array:
    """The words of the texts, one for each run of letters A-Z, a-z and U+00C0-U+00FF that leaves enough code points.

    ``prefixes``: what stands before the run where its crc32 is taken; where
    ``every`` divides that, the code point at its remainder by the run's length is deleted."""
    raw, offsets = utf8(texts)
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    tail = np.zeros(len(raw), bool)
    tail[1:] = raw[:-1] == 0xC3  # the second byte of U+00C0-U+00FF
    inside = _LETTER[raw] | (raw == 0xC3) | tail
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    heads = np.concatenate(([0], np.cumsum(~tail)))
    points = heads[end] - heads[start]
    doc = np.searchsorted(offsets, start, side="right") - 1
    state = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    crc = crc_of(raw, start, end, state[doc])
    hit = crc % every == 0
    whole = ~hit & (points >= least)
    cut = []
    for s, e, h in zip(start[hit & (points > least)], end[hit & (points > least)], crc[hit & (points > least)]):
        word = raw[s:e].tobytes().decode()
        k = int(h) % len(word)
        cut.append(word[:k] + word[k + 1:])
    start, size = start[whole], (end - start)[whole]
    ends = np.cumsum(size)
    take = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
    data = raw[take]
    out = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data))
    return pa.concat_arrays([out, pa.array(cut, pa.string())])


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", every: int = 199, least: int = 6,
                at_least: int = 5, lot_bytes: int = 1 << 22, flush: int = 1 << 19) -> DataFrame:
    """(word, n) of the words that occur often enough; occurrences are summed in each task before the shuffle."""
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def summed(held: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return pa.table({"word": got["word"], "n": got["n_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            upto, at = np.concatenate(([0], np.cumsum(lengths.astype(np.int64)))), 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + lot_bytes, side="right")) - 1)
                words = runs(batch.column(1).slice(at, end - at), [f"{i}:".encode() for i in ids[at:end]], every, least)
                got = pc.value_counts(words)
                held.append(pa.table({"word": got.field(0), "n": got.field(1)}))
                size, at = size + len(got), end
                if size > flush:
                    held = [summed(held)]
                    size = held[0].num_rows
                    if size > flush // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    got = rows.mapInArrow(run, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


PATH = "kind string, way int, node long, sign string, child long, id long, ahead string, left int"
NAMES = ["kind", "way", "node", "sign", "child", "id", "ahead", "left"]


def paths(words: DataFrame, least: int) -> DataFrame:
    """The second halves of the words' ways through the tries, forwards and backwards.

    There is one trie for each word length and direction; a node is the hash
    of both and the prefix. An edit in the second half of a word leaves its
    first half as it is, and one in the first half is in the second half of
    the reversed word, so no walk starts nearer to a root than half way.
    ``own`` rows are the edges of the word itself, the last one with the empty
    sign. ``cut`` rows stand where one character has been left out, in the
    trie of the words that are one shorter; of equal neighbours only the last is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                lot = batch.slice(a, 2000)
                ids = lot.column(0).to_numpy(zero_copy_only=False)
                for way, words in enumerate((lot.column(1).to_pylist(), [w[::-1] for w in lot.column(1).to_pylist()])):
                    yield from steps(ids, words, way)

    def steps(ids: np.ndarray, words: list[str], way: int) -> Iterator[pa.RecordBatch]:
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        text = "".join(words)
        points = mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        half = size // 2 if way == 0 else size - size // 2
        many = size - half + 1
        of = np.repeat(np.arange(len(words)), many)
        for s in range(0, len(of), 1 << 19):  # bounded lots: a word may be very long
            part = of[s:s + (1 << 19)]
            depth = half[part] + np.arange(s, s + len(part)) - (np.cumsum(many) - many)[part]
            at = start[part]

            def node(deep: np.ndarray, length: np.ndarray) -> np.ndarray:
                return mixed(span_hash(points, at, at + deep) + (2 * length + way).astype(np.uint64)).astype(np.int64)

            inner = depth < size[part]
            own = node(depth, size[part])
            child = np.where(inner, node(np.minimum(depth + 1, size[part]), size[part]), 0)
            less = node(depth, size[part] - 1)
            place = at + depth
            signs = [text[p] if x else "" for p, x in zip(place.tolist(), inner.tolist())]
            stop = (at + size[part]).tolist()
            rest = [text[p + 1:min(p + 1 + AHEAD, e)] for p, e in zip(place.tolist(), stop)]
            left = size[part] - depth - 1
            yield pa.record_batch([pa.array(["own"] * len(part)), pa.array(np.full(len(part), way, np.int32)), pa.array(own), pa.array(signs), pa.array(child), pa.array(ids[part]),
                                   pa.array(rest), pa.array(np.maximum(left, 0).astype(np.int32))],
                                  names=NAMES)
            cut = inner & (size[part] > least)
            k = np.flatnonzero(cut)
            k = k[[rest[i][:1] != signs[i] for i in k.tolist()]] if len(k) else k
            yield pa.record_batch([pa.array(["cut"] * len(k)), pa.array(np.full(len(k), way, np.int32)), pa.array(less[k]), pa.array([rest[i][:1] for i in k.tolist()], pa.string()),
                                   pa.array(np.zeros(len(k), np.int64)), pa.array(ids[part][k]),
                                   pa.array([text[p + 2:min(p + 2 + AHEAD, stop[i])] for i, p in zip(k.tolist(), place[k].tolist())], pa.string()),
                                   pa.array(np.maximum(left[k] - 1, 0).astype(np.int32))],
                                  names=NAMES)

    return words.select("id", "word").mapInArrow(run, PATH)


def near_pairs(words: DataFrame, least: int = 6) -> DataFrame:
    """(a, b): ids of all pairs of ``words`` (id, word) that differ by one inserted, deleted or replaced code point, once each.

    A state is a word, its unread rest and the node it has come to with its
    one edit made. Each level joins all states with the edge table on (node,
    next sign). An edge under which one word is left ends the walk: that word
    is a candidate, and candidates are compared as strings at the end, so hashes decide nothing.
    Every level is written to the shared folder."""
    walk = stash(paths(words, least), "spell-paths")
    own = walk.where("kind = 'own'")
    edges = stash(own.groupBy("node", "sign", "child").agg(F.count("*").alias("below"), F.min("id").alias("only")), "spell-edges")
    reached = ["id", "way", "child", "ahead", "left", "below", "only"]
    # no edit but a replaced sign: the other edges of the word's own nodes, the larger sign's only, so that each pair is met once
    forks = edges.groupBy("node").count().where("count > 1").select("node")
    other = edges.join(forks, "node", "left_semi").where("sign <> ''").withColumnRenamed("sign", "turn")
    swaps = own.where("sign <> ''").drop("child").join(other, "node").where(F.col("turn") > F.col("sign")).select(*reached)
    cuts = walk.where("kind = 'cut'").drop("child").join(edges, ["node", "sign"]).select(*reached)
    state, found = stash(swaps.unionByName(cuts), "spell-states"), []
    while True:
        found.append(state.where("below = 1").select("id", "only"))
        state = state.where("below > 1").select("id", "way", F.col("child").alias("node"), "ahead", "left")
        told = state.agg(F.count("*"), F.max((F.col("ahead") == "") & (F.col("left") > 0))).first()
        if not told[0]:
            break
        if told[1]:  # a long word whose carried characters are used up
            whole = words.select("id", "word", F.length("word").alias("size"))
            rest = F.expr(f"substring(if(way = 0, word, reverse(word)), size - left + 1, {AHEAD})")
            state = state.join(whole, "id").select("id", "way", "node", "left", F.when(F.col("ahead") != "", F.col("ahead")).otherwise(rest).alias("ahead"))
        step = state.select("id", "way", "node", F.substring("ahead", 1, 1).alias("sign"), F.expr("substring(ahead, 2)").alias("ahead"),
                            F.greatest(F.col("left") - 1, F.lit(0)).alias("left"))
        state = stash(step.join(edges, ["node", "sign"]).select(*reached), "spell-states")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.select(F.least("id", "only").alias("a"), F.greatest("id", "only").alias("b")).where("a <> b").distinct()
    named = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("left_word")), "a").join(
        words.select(F.col("id").alias("b"), F.col("word").alias("right_word")), "b")
    return named.where(F.levenshtein("left_word", "right_word", 1) == 1).select("a", "b")


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", every: int = 199, least: int = 6, at_least: int = 5,
             factor: int = 5) -> DataFrame:
    """One row a word: word, form, root (string), n, n_near, form_n (long).

    Words are the runs of A-Z, a-z and U+00C0-U+00FF of whole texts, A-Z
    lower-cased, of at least ``least`` code points and ``at_least``
    occurrences; where ``every`` divides the crc32 of "<doc_id>:<run>", the
    run's code point at its remainder by the length is deleted first. A null
    doc_id counts as an empty one, repeated rows count each time. A word's form is
    its near word of the largest n (ties: smallest in code-point order), if that is at least
    ``factor`` times its own n. Roots follow forms by pointer doubling: n grows ``factor``-fold with each
    form, so the number of rounds is the logarithm of a logarithm of the input. Empty
    tables and null texts give no words; other columns are ignored."""
    words = stash(word_counts(docs, doc_id=doc_id, text=text, every=every, least=least, at_least=at_least)
                  .withColumn("id", F.monotonically_increasing_id()), "spell-words")
    pairs = stash(near_pairs(words, least), "spell-pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near", "b")).alias("best"))
    told = words.join(best, words["id"] == best["a"], "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"), F.col("best.b").alias("form_id"))).alias("to"))
    told = stash(told.select("id", "word", "n", "n_near", "to.form", "to.form_n", "to.form_id"), "spell-forms")
    roots = told.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id"))
    while True:
        onward = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        roots = stash(roots.join(onward, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.select("id", "root_id")
    named = roots.select("id", "root_id").join(words.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return told.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
