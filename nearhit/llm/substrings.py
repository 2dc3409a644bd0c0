"""Substring dedup on words: super-k-mer partitioning, then exact counting by sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearhit.llm.common import WS, byte_slices
from nearhit.llm.superkmer import Units, covered, keyed, mixed, repeated_marks, span_hash, with_marks

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in WS]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


class Words(Units):
    """Words of a text, joined by one space."""

    def __init__(self, width: int, gram: int = 6, piece: int = 1 << 16):
        super().__init__(width, min(gram, width), piece)

    def parse(self, text: bytes) -> tuple:
        joined, lengths, hashes = [], [], []
        for part in byte_slices(text):
            raw = np.frombuffer(part, np.uint8)
            blank = np.concatenate(([True], _BLANK[raw], [True]))
            start = np.flatnonzero(blank[:-2] & ~blank[1:-1])
            end = np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
            if len(start):
                joined.append(b" ".join(part.split()))
                lengths.append(end - start)
                hashes.append(span_hash(_BYTE[raw], start, end))
        if not joined:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        length = np.concatenate(lengths)
        ends = np.cumsum(length + 1) - 1
        return b" ".join(joined), ends - length, ends, np.concatenate(hashes)

    def size(self, doc: tuple) -> int:
        return len(doc[1])

    def hashes(self, doc: tuple, a: int, b: int) -> np.ndarray:
        return doc[3][a:b]

    def places(self, doc: tuple, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return doc[1][first], doc[2][last]

    def windows(self, string: bytes, n: int | None = None) -> list[bytes]:
        gap = np.flatnonzero(np.frombuffer(string, np.uint8) == 32)
        start, end = np.concatenate(([0], gap + 1)), np.append(gap, len(string))
        return [string[a:b] for a, b in zip(start[:len(start) - self.width + 1].tolist(), end[self.width - 1:].tolist())]

    def find(self, strings: list[bytes]) -> list[list[tuple[int, int]]]:
        """Word ranges of each string that its repeated windows cover: all windows sorted, equal ones stand side by side."""
        parts = [self.windows(s) for s in strings]
        flat = [w for p in parts for w in p]
        order = sorted(range(len(flat)), key=flat.__getitem__)
        again = np.zeros(len(flat), bool)
        for a, b in zip(order, order[1:]):
            if flat[a] == flat[b]:
                again[a] = again[b] = True
        out, at = [], 0
        for p in parts:
            hit = np.concatenate(([False], again[at:at + len(p)], [False]))
            first, stop = np.flatnonzero(~hit[:-1] & hit[1:]), np.flatnonzero(hit[:-1] & ~hit[1:])
            out.append([(int(a), int(b) + self.width - 1) for a, b in zip(first, stop)])
            at += len(p)
        return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 35, **limits) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the kept words, joined by one space).

    Each word covered by a window of ``width`` words that also starts
    anywhere else, same document included, is removed; windows are judged on
    the input. Exact: windows are compared as strings, in buckets by
    minimiser (see ``superkmer``). Null or wordless texts: 0 words and an
    empty text. Repeated rows repeat each other's windows. An empty table
    gives no rows. Other columns are ignored."""
    units = Words(width)
    texts = keyed(docs, doc_id, text)
    marked = with_marks(texts, repeated_marks(texts, units, units.find, **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for t, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (t or "").encode().split()
                gone = covered(marks, len(words))
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if removed[-1] else b" ".join(words))
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                   pa.array([k.decode() for k in kept], pa.string())],
                                  names=["doc_id", "n_words", "n_removed", "kept_text"])

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
