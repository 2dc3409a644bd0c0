"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from nearhit.llm.common import byte_slices

OUT = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "loss_tokens long")


_SMALL, _CAPITAL, _SIGN = (np.zeros(256, bool) for _ in range(3))
_SMALL[97:123] = _CAPITAL[65:91] = True
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # no apostrophe
#: Words that the vocabulary's pattern keeps in one piece: letters a-z and U+00C0-U+00FF, or signs.
_WHOLE = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")


def canonical(text: bytes) -> bytes:
    """A text with the same ids and fewer different words: A-Z lower-cased, letters and signs set apart.

    The vocabulary lower-cases after composing marks, so a capital before a
    possible mark is left alone. Its pattern never joins a letter and a sign,
    but for the apostrophe. A text that may hold a special token is left as it is."""
    if b"<|" in text:
        return text
    raw = np.frombuffer(text, np.uint8)
    after = np.append(raw[1:], 32)
    raw = raw + ((_CAPITAL[raw] & (after < 0xCC)).astype(np.uint8) << 5)
    ascii_letter, sign = _SMALL[raw], _SIGN[raw]
    latin = np.zeros(len(raw), bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut = np.flatnonzero(((ascii_letter | latin)[:-1] & sign[1:]) | (sign[:-1] & ascii_letter[1:]))
    return np.insert(raw, cut + 1, 32).tobytes()


class _Codes(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class Encoder:
    """Token ids of UTF-8 texts, with a cache of blank-separated words.

    The vocabulary drops white space and none of its pieces spans any, so a
    text's ids are those of its words one after the other. At most
    ``cache_words`` words are kept; then the cache starts anew."""

    _loaded: dict[tuple, Encoder] = {}

    def __init__(self, path: str, cache_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder a Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _clear(self) -> None:
        self.codes, self.size, self.used = _Codes(), 0, 0
        self.first, self.count, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word)."""
        whole = np.fromiter((_WHOLE.fullmatch(w) is not None for w in words), bool, len(words))
        plain = [w.decode() for w, x in zip(words, whole) if x]
        got = self.tokenizer.encode_batch_fast([" ".join(plain[i:i + 512]) for i in range(0, len(plain), 512)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got] + [np.zeros(0, np.uint32)])
        last = np.flatnonzero(self.ends[ids])  # a word's last piece carries the end mark
        if len(last) != len(plain):
            whole[:] = False
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w, x in zip(words, whole) if not x], add_special_tokens=False)]
        count = np.zeros(len(words), np.int64)
        if whole.any():
            count[whole] = np.diff(np.concatenate(([-1], last)))
        count[~whole] = [len(x) for x in rest]
        out, of = np.zeros(int(count.sum()), np.uint32), np.repeat(whole, count)
        if whole.any():
            out[of] = ids
        out[~of] = [i for x in rest for i in x]
        return out, count

    def _learn(self, words: list[bytes]) -> None:
        ids, count = self._ids(words)

        def room(x: np.ndarray, n: int) -> np.ndarray:
            return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))

        size, used = self.size + len(words), self.used + len(ids)
        self.first, self.count, self.flat = room(self.first, size), room(self.count, size), room(self.flat, used)
        self.first[self.size:size] = self.used + np.cumsum(count) - count
        self.count[self.size:size], self.flat[self.used:used] = count, ids
        self.size, self.used = size, used

    def encode(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        """Ids of each text. The texts of one call are looked up together."""
        if self.size > self.cache_words:
            self._clear()
        rows = []
        for text in texts:
            parts = []
            for piece in byte_slices(text):
                words = canonical(piece).split()
                parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
            rows.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        if len(self.codes) > self.size:
            self._learn(list(islice(self.codes, self.size, None)))
        out = []
        for row in rows:
            count = self.count[row]
            at = np.repeat(self.first[row] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            out.append(self.flat[at])
        return out


class Packer:
    """Fills one sequence at a time from a pool of pieces.

    The next piece is the one whose demand (tokens, one segment, loss-bearing
    tokens, each over its limit) has the largest dot product with what is
    left of the sequence, among those that fit. When none fits, or one
    segment is left, a piece is cut so that the sequence ends full. A
    sequence that still ends short is cut back to a power of two, which needs
    no padding."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = 256):
        self.limit = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.pool = pool
        self.items: list[list] = []  # [key, ids, loss running sum, next start]
        self.tokens, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[tuple]]:
        run = np.concatenate(([0], np.cumsum(loss, dtype=np.int64)))
        start, full = 0, int(self.limit[0])
        while len(ids) - start >= full and run[start + full] - run[start] <= self.limit[2]:
            yield [(key, ids, run, start, full)]
            start += full
        if start < len(ids):
            self._put([key, ids, run, start])
        while len(self.items) >= self.pool:
            yield self._fill()

    def finish(self) -> Iterator[list[tuple]]:
        while self.items:
            yield self._fill()

    def _put(self, item: list) -> None:
        self.items.append(item)
        self.tokens = np.append(self.tokens, len(item[1]) - item[3])
        self.loss = np.append(self.loss, item[2][-1] - item[2][item[3]])

    def _take(self, i: int, length: int) -> tuple:
        key, ids, run, start = self.items[i]
        if length == self.tokens[i]:
            last = len(self.items) - 1
            self.items[i], self.tokens[i], self.loss[i] = self.items[last], self.tokens[last], self.loss[last]
            self.items.pop()
            self.tokens, self.loss = self.tokens[:last], self.loss[:last]
        else:
            self.items[i][3] = start + length
            self.tokens[i] -= length
            self.loss[i] -= run[start + length] - run[start]
        return key, ids, run, start, length

    def _fill(self) -> list[tuple]:
        left, out = self.limit.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            fits = (self.tokens <= left[0]) & (self.loss <= left[2])
            if left[1] == 1 and (self.tokens >= left[0]).any():
                fits[:] = False
            share = left / self.limit / self.limit
            gain = self.tokens * share[0] + share[1] + self.loss * share[2]
            if fits.any():
                i = int(np.argmax(np.where(fits, gain, -1.0)))
                length = int(self.tokens[i])
            else:  # cut the piece of the largest product
                i = int(np.argmax(gain))
                _, _, run, start = self.items[i]
                room = np.searchsorted(run, run[start] + left[2], side="right") - 1 - start
                length = int(min(self.tokens[i], left[0], room))
                if length <= 0:
                    break
            lost = self.loss[i]
            piece = self._take(i, length)
            lost = piece[2][piece[3] + length] - piece[2][piece[3]]
            left -= (length, 1, lost)
            out.append(piece)
        return self._even(out)

    def _even(self, out: list[tuple]) -> list[tuple]:
        """Put back what lies above the largest power of two, unless the sequence is full."""
        total = sum(p[4] for p in out)
        extra = 0 if total == self.limit[0] else total - (1 << (total.bit_length() - 1))
        while extra:
            key, ids, run, start, length = out.pop()
            keep = max(0, length - extra)
            extra -= length - keep
            if keep:
                out.append((key, ids, run, start, keep))
            end = start + length  # the tail returns as a piece of its own, ending where it was cut
            self._put([key, ids[:end], run[:end + 1], start + keep])
        return out


def pack(docs: DataFrame, *, tokenizer_path: str, doc_id: str = "doc_id", parts: tuple = (("text", True),),
         end_id: int = 2, max_tokens: int = 4096, max_segments: int = 256, max_loss: int = 4096) -> DataFrame:
    """One row per placed piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    An example's ids are those of its ``parts`` (column, whether its tokens
    bear loss), one after the other, then ``end_id`` (bearing loss). Every
    sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and
    ``max_loss`` loss-bearing tokens; its length is ``max_tokens`` or a power of two.

    Each input partition is packed where it lies: no shuffle, and a lost task
    is simply run again. ``sequence_id`` holds the partition number above bit
    36. Null parts are empty; an empty example is its ``end_id`` alone;
    repeated rows are packed once each; an empty table gives no rows."""
    cols = list(dict.fromkeys(c for c, _ in parts))
    frame = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), *[docs[f"`{c}`"].cast("string").alias(f"part_{c}") for c in cols])
    kind = dict(frame.dtypes)["doc_id"]
    spots = [(cols.index(c) + 1, bears) for c, bears in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder.of(tokenizer_path), Packer(max_tokens, max_segments, max_loss)
        base, made, id_type = TaskContext.get().partitionId() << 36, 0, None
        rows: list[tuple] = []

        def place(sequence: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for (key, size), ids, loss, start, length in sequence:
                crc = zlib.crc32(np.ascontiguousarray(ids[start:start + length], dtype="<u4"))
                rows.append((key, start, length, crc, size, base + made, offset, int(loss[start + length] - loss[start])))
                offset += length
            made += 1

        def flush() -> pa.RecordBatch:
            data = list(zip(*rows))
            rows.clear()
            return pa.record_batch([pa.array(data[0], id_type), *[pa.array(c, pa.int64()) for c in data[1:]]],
                                   names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                          "offset", "loss_tokens"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [[(t or "").encode() for t in part.column(i).to_pylist()] for i, _ in spots]
                coded = [encoder.encode(t) for t in texts]
                for n, key in enumerate(part.column(0).to_pylist()):
                    ids = np.concatenate([c[n] for c in coded] + [np.array([end_id], np.uint32)])
                    loss = np.concatenate([np.full(len(c[n]), b, np.int8) for c, (_, b) in zip(coded, spots)]
                                          + [np.ones(1, np.int8)])
                    for sequence in packer.add((key, len(ids)), ids, loss):
                        place(sequence)
                if len(rows) >= 4096:
                    yield flush()
        for sequence in packer.finish():
            place(sequence)
        if rows:
            yield flush()

    return frame.mapInArrow(run, OUT.format(id=kind))
