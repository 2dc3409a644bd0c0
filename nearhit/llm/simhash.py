"""SimHash near-dedup through a byte-position index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhit.llm.common import byte_slices, components, stash

BYTES = 8


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) words' shingles."""
    ones, total, carry, hashed = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for piece in byte_slices(text):
        words = carry + piece.lower().split()
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([hashed(joined[a:b], 42) for a, b in
                           zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())], np.uint64)
        for a in range(0, len(hashes), 1 << 16):
            part = hashes[a:a + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total, carry = total + len(hashes), words[len(words) - shingle + 1:]
    if not total and carry:
        return int(np.array([hashed(b" ".join(carry), 42)], np.uint64).view(np.int64)[0])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                 tag: Column | None = None) -> DataFrame:
    """(doc_id, tag, fp) of every row; no words: fp 0."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       (F.lit(0) if tag is None else tag).cast("long").alias("tag"),
                       F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.encode(), shingle) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "tag", "fp"])

    return rows.mapInArrow(run, "doc_id long, tag long, fp long")


def _closer(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all of ``values`` (distinct) that a path of pairs within ``distance`` bits connects.

    A breadth-first walk that links each value once, to the one it was found
    from, so a list of any size gives fewer links than values. Few values left:
    compared with all of them; many: looked up at every flip of the free bits."""
    links, rest = [], np.sort(values.view(np.uint64))
    free = np.flatnonzero(np.unpackbits(
        np.array([np.bitwise_or.reduce(rest) & ~np.bitwise_and.reduce(rest)], np.uint64).view(np.uint8), bitorder="little"))
    bits = np.uint64(1) << free.astype(np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.array(c, np.uint64)) for n in range(1, distance + 1)
                      for c in combinations(bits, n)], np.uint64)
    alive = np.ones(len(rest), bool)
    for seed in range(len(rest)):
        if not alive[seed]:
            continue
        alive[seed], todo = False, [rest[seed]]
        while todo:
            at = todo.pop()
            if 4 * len(flips) < len(rest):
                want = at ^ flips
                spot = np.minimum(np.searchsorted(rest, want), len(rest) - 1)
                spot = spot[(rest[spot] == want) & alive[spot]]
            else:
                spot = np.flatnonzero(alive & (np.bitwise_count(rest ^ at) <= distance))
            alive[spot] = False
            links += [(int(at), int(v)) for v in rest[spot]]
            todo += list(rest[spot])
    return links


def links(fps: DataFrame, distance: int = 3, short: int = 16) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that join all within ``distance`` bits.

    Two fingerprints at most ``distance`` bits apart share at least
    ``8 - distance`` positional bytes. A posting list of one positional byte
    would hold 1/256 of all fingerprints, and tallying its pairs would grow with the
    square of the input; so the index is kept on every combination of that
    many positions (56 for distance 3): two fingerprints meet in a list
    exactly when their tally of shared bytes reaches the guaranteed minimum.
    Pairs of a list are kept once, in their first common combination, and
    verified by their bits. A list longer than ``short`` gives connecting links instead of its pairs."""
    need = BYTES - distance
    combos = list(combinations(range(BYTES), need))
    masks = [sum(0xFF << (8 * p) for p in c) for c in combos]
    first = np.full(256, -1, np.int16)
    for shared in range(256):
        for i, c in enumerate(combos):
            if all(shared >> p & 1 for p in c):
                first[shared] = i
                break
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    posted = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
        for i, m in enumerate(signed)])).alias("p")).select("p.c", "p.k", "fp")

    def group(c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        out: list = []
        edge = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (k[1:] != k[:-1]), [True])))
        size = np.diff(edge)
        of = np.repeat(np.arange(len(size)), size)
        small = (size <= short)[of]
        raw = fp.view(np.uint64)
        for lag in range(1, short):
            at = np.flatnonzero((of[lag:] == of[:-lag]) & small[lag:]) if lag < len(fp) else np.zeros(0, np.int64)
            if not len(at):
                break
            x = raw[at] ^ raw[at + lag]
            shared = np.packbits((x.view(np.uint8).reshape(-1, 8) == 0), axis=1, bitorder="little")[:, 0]
            at = at[(first[shared] == c[at]) & (np.bitwise_count(x) <= distance)]
            out += zip(fp[at].tolist(), fp[at + lag].tolist())
        for g in np.flatnonzero(size > short):
            found = np.array(_closer(fp[edge[g]:edge[g + 1]], distance), np.uint64).reshape(-1, 2).view(np.int64)
            out += map(tuple, found.tolist())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def emit(pairs):
            a, b = zip(*pairs) if pairs else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            now = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.argmax(same))  # the last list may go on in the next batch
            held = [x[cut:] for x in now]
            if cut:
                yield emit(group(*[np.ascontiguousarray(x[:cut]) for x in now]))
        if len(held[0]):
            yield emit(group(*map(np.ascontiguousarray, held)))

    spread = posted.repartition("c", "k").sortWithinPartitions("c", "k", "fp")
    return spread.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3,
                    tag: Column | None = None) -> DataFrame:
    """One row per document: doc_id, tag, fingerprint (16 hex digits), component_id, root.

    Fingerprints at most ``distance`` bits apart are linked; ``component_id``
    is the smallest doc_id of a document's component and ``root`` the
    component's smallest fingerprint, as a signed long. Documents of one fingerprint
    are collapsed before the index, so copies cost nothing there.

    Null or wordless texts have fingerprint zero and are linked like any
    other. Repeated rows are rows of one component. Null ids are never the
    smallest; a component of null ids only has a null id. An empty table gives no rows. Other columns are ignored."""
    rows = stash(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, tag=tag), "simhash-fp")
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = components(links(fps.select("fp"), distance), tag="simhash-links")
    rooted = fps.join(found, fps["fp"] == found["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", "tag", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")
