"""Suffix-array dedup on bytes: a run-length Burrows-Wheeler index with sampled run ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearhit.llm.superkmer import Units, covered, keyed, mixed, repeated_marks, with_marks

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
PACK = 7  # symbols of nine bits in one sort key


class Bytes(Units):
    """Bytes of a text."""

    def __init__(self, width: int, gram: int = 40, piece: int = 1 << 19):
        super().__init__(width, min(gram, width), piece)

    def parse(self, text: bytes) -> tuple:
        return (text,)

    def size(self, doc: tuple) -> int:
        return len(doc[0])

    def hashes(self, doc: tuple, a: int, b: int) -> np.ndarray:
        return _BYTE[np.frombuffer(doc[0], np.uint8, b - a, a)]

    def places(self, doc: tuple, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first, last + 1

    def windows(self, string: bytes, n: int) -> list[bytes]:
        return [string[i:i + self.width] for i in range(n)]

    def find(self, strings: list[bytes]) -> list[list[tuple[int, int]]]:
        return RunIndex(strings).repeats(self.width)


def suffix_array(symbols: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from packed keys; only suffixes still tied are sorted again."""
    n = len(symbols)
    sa = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    step = PACK
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # places whose suffix is tied with a neighbour's
    while len(slots):
        at = sa[slots]
        ahead = at + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        sa[slots] = at
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        step *= 2
    return sa


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with the suffix places sampled at the runs' ends.

    ``head`` and ``length`` are the runs. ``sample`` holds, for every border
    between two runs, the two suffixes on its sides: these are the only
    neighbours in suffix order whose common prefix can't be extended to the
    left, and all other neighbours are extensions of one of them."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.end = np.cumsum(size + 1) - 1  # each string is followed by a separator, the lowest symbol
        self.start = self.end - size
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.text = raw.astype(np.int64) + 1
        self.text[self.end] = 0
        key = np.zeros(len(raw), np.int64)
        for i in range(PACK):
            key <<= 9
            key[:len(raw) - i] |= self.text[i:]
        self.key = key
        sa = suffix_array(self.text, key)
        last = np.where(sa > 0, self.text[sa - 1], 0)  # the transform
        border = np.flatnonzero((last[1:] != last[:-1]) | (last[1:] == 0)) + 1
        self.head = last[np.concatenate(([0], border))]
        self.length = np.diff(np.concatenate(([0], border, [len(sa)])))
        self.sample = np.stack((sa[border], sa[border - 1]))

    def statistics(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, length) of the sampled matches of at least ``least`` symbols, each within its strings."""
        i, j = self.sample
        room = self.end[np.searchsorted(self.end, i)] - i
        room = np.minimum(room, self.end[np.searchsorted(self.end, j)] - j)
        keep = (room >= least) & (self.key[i] == self.key[j])
        i, j, room = i[keep], j[keep], room[keep]
        length, open_, block = np.zeros(len(i), np.int64), np.arange(len(i)), 32
        while len(open_):
            reach = np.arange(block)
            a = np.minimum(i[open_] + length[open_], len(self.text) - 1)[:, None] + reach
            b = np.minimum(j[open_] + length[open_], len(self.text) - 1)[:, None] + reach
            same = self.text[np.minimum(a, len(self.text) - 1)] == self.text[np.minimum(b, len(self.text) - 1)]
            run = np.where(same.all(axis=1), block, np.argmin(same, axis=1))
            length[open_] += run
            open_ = open_[(run == block) & (length[open_] < room[open_])]
            block = min(4096, block * 2) if len(open_) < 4096 else block
        length = np.minimum(length, room)
        keep = length >= least
        return i[keep], j[keep], length[keep]

    def repeats(self, least: int) -> list[list[tuple[int, int]]]:
        """Ranges of each string that strings of ``least`` symbols with another place cover.

        The matching statistic of a place is that of its sample less the
        distance to it, so a sampled match of length l covers l places on both of its sides."""
        i, j, length = self.statistics(least)
        step = np.zeros(len(self.text) + 1, np.int64)
        for at in (i, j):
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
        hit = np.concatenate(([False], np.cumsum(step[:-1]) > 0, [False]))
        first, stop = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
        out: list[list[tuple[int, int]]] = [[] for _ in self.end]
        for s, a, b in zip(np.searchsorted(self.end, first).tolist(), first.tolist(), stop.tolist()):
            out[s].append((a - int(self.start[s]), b - int(self.start[s])))
        return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 200, **limits) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes).

    Each byte covered by a ``width``-byte string that also starts anywhere
    else, same document included, is removed; strings are judged on the
    input, and matches never cross documents. Strings that may repeat are
    gathered by minimiser (see ``superkmer``); each bucket builds a run-length
    index of its distinct strings and streams the matching statistics from
    the sampled run ends. Null texts are empty. Repeated rows repeat each
    other's strings. An empty table gives no rows. Other columns are ignored."""
    units = Bytes(width)
    texts = keyed(docs, doc_id, text)
    marked = with_marks(texts, repeated_marks(texts, units, units.find, **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for t, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (t or "").encode()
                gone = covered(marks, len(raw)) if marks else None
                size.append(len(raw))
                removed.append(0 if gone is None else int(gone.sum()))
                spans.append(0 if gone is None else int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                kept.append(raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in (size, removed, spans)],
                                   pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
