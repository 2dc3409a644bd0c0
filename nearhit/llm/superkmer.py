"""Super-k-mer partitioning: runs of consecutive windows that share a minimiser travel together.

Shared by the two exact substring operators. A document is a sequence of
units (words or bytes); a window is ``width`` consecutive units; its minimiser
is the smallest hash among its ``gram``-unit grams. Equal windows have equal
minimisers, so a repeated window can be found by looking at one minimiser's
strings alone:

1. every document is cut into super-k-mers, each a narrow row of minimiser,
   string digest and place. Equal strings of one input task are collapsed to
   one row before the shuffle, as copies have most of the rows;
2. rows meet by minimiser. One that nobody shares ends there. A string that
   comes twice is repeated as a whole. Only strings that share a minimiser
   with a different string are looked into;
3. one copy of each such string is cut from its document, packed, and sent to
   its minimiser's bucket, where ``find`` marks the repeated windows exactly.
   A minimiser with more than ``bucket_units`` units in different strings is
   not sent to one bucket: its windows are dealt out by their own digests
   and counted with map-side sums;
4. the marks are grouped by document and joined to the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearhit.llm.common import stash, utf8

POS = 20  # bits for a place within a piece of a document
_ROW = ("done boolean, m long, dig long, doc long, tag long, start long, n long, own boolean, twin boolean")
_ROW_SCHEMA = pa.schema([("done", pa.bool_()), ("m", pa.int64()), ("dig", pa.int64()), ("doc", pa.int64()),
                         ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("own", pa.bool_()),
                         ("twin", pa.bool_())])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2^64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        have = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_ODD, _ODD_INVERSE))
        _POWERS[0] = have
    return have[0][:n], have[1][:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``, from running sums."""
    up, down = _powers(len(values) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, from block-wise running minima."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def runs(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser, own) of the runs of windows that share a minimiser.

    ``own``: the minimiser stands at two places of the run, so a window may repeat within it."""
    place = np.arange(len(grams), dtype=np.uint64)
    high, mask = (grams >> np.uint64(POS)) << np.uint64(POS), np.uint64((1 << POS) - 1)
    left = sliding_min(high | place, w) & mask
    right = mask - (sliding_min(high | (mask - place), w) & mask)
    best = grams[left]
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    count = np.diff(np.append(first, len(best)))
    return first, count, best[first], left[first] != right[first + count - 1]


class Units:
    """What the two operators' unit sequences have in common. A parsed document is a tuple whose first item is its bytes."""

    def __init__(self, width: int, gram: int, piece: int):
        self.width, self.gram, self.piece = width, gram, min(piece, (1 << POS) - width)

    def parse(self, text: bytes) -> tuple:
        raise NotImplementedError

    def size(self, doc: tuple) -> int:
        raise NotImplementedError

    def hashes(self, doc: tuple, a: int, b: int) -> np.ndarray:
        """A 64-bit hash of each unit from a to b."""
        raise NotImplementedError

    def places(self, doc: tuple, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places where spans of units start and end."""
        raise NotImplementedError

    def windows(self, string: bytes, n: int) -> list[bytes]:
        """The n windows of a super-k-mer."""
        raise NotImplementedError

    def super_kmers(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(minimiser, digest, first unit, windows, own) arrays, piece by piece of the document."""
        doc = self.parse(text)
        view, size = memoryview(doc[0]), self.size(doc)
        for at in range(0, size - self.width + 1, self.piece):
            unit = self.hashes(doc, at, min(size, at + self.piece + self.width - 1))
            k = np.arange(len(unit) - self.gram + 1)
            first, count, best, own = runs(span_hash(unit, k, k + self.gram), self.width - self.gram + 1)
            a, b = self.places(doc, at + first, at + first + count + self.width - 2)
            digest = np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())], np.uint64)
            yield best.view(np.int64), digest.view(np.int64), at + first, count, own

    def cut(self, text: bytes, first: list[int], count: list[int]) -> list[bytes]:
        """The bytes of super-k-mers of a document."""
        doc, at = self.parse(text), np.array(first)
        a, b = self.places(doc, at, at + np.array(count) + self.width - 2)
        return [doc[0][x:y] for x, y in zip(a.tolist(), b.tolist())]


def _probe_rows(units: Units, collapse: int):
    """Stage 1 on a partition: super-k-mers, equal strings collapsed in lots of ``collapse`` rows."""

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        m, dig, doc, tag, start, n, own = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((dig, m))
        m, dig, doc, tag, start, n, own = (x[order] for x in (m, dig, doc, tag, start, n, own))
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (dig[1:] != dig[:-1])))
        twin = ~new | np.append(~new[1:], False)
        again = np.flatnonzero(twin)  # every place of a string that came twice is settled here
        probe = np.flatnonzero(new)  # and one row of each string goes on
        pick = np.concatenate((probe, again))
        done = np.repeat([False, True], [len(probe), len(again)])
        return pa.record_batch([pa.array(c) for c in (done, m[pick], dig[pick], doc[pick], tag[pick], start[pick], n[pick],
                                                      own[pick], twin[pick])], schema=_ROW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            data, at = utf8(batch.column(2))
            docs, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(batch.num_rows):
                if at[i + 1] - at[i] < units.width:
                    continue
                for best, digest, first, count, own in units.super_kmers(data[at[i]:at[i + 1]].tobytes()):
                    many = len(best)
                    held.append((best, digest, np.full(many, docs[i]), np.full(many, tags[i]), first, count, own))
                    rows += many
                if rows >= collapse:
                    yield settle(held)
                    held, rows = [], 0
        if rows:
            yield settle(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 2 on rows sorted by (done, m, dig): drop strings whose minimiser nobody shares; mark twins and heads.

    Looks at neighbouring rows only, so a minimiser's rows are never held together."""
    schema = _ROW_SCHEMA.append(pa.field("head", pa.bool_()))

    def judge(before, rows: pa.Table, after) -> list[pa.RecordBatch]:
        key = [np.concatenate(([b], rows.column(i).to_numpy(zero_copy_only=False), [a]))
               for i, b, a in zip((0, 1, 2), before, after)]
        same_m = (key[0][1:] == key[0][:-1]) & (key[1][1:] == key[1][:-1])
        same = same_m & (key[2][1:] == key[2][:-1])
        done = rows.column(0).to_numpy(zero_copy_only=False).astype(bool)
        keep = done | same_m[:-1] | same_m[1:] | rows.column(7).to_numpy(zero_copy_only=False)
        twin = rows.column(8).to_numpy(zero_copy_only=False) | (~done & (same[:-1] | same[1:]))
        out = rows.set_column(8, "twin", pa.array(twin)).append_column("head", pa.array(~same[:-1] & ~done))
        return out.filter(pa.array(keep)).cast(schema).to_batches()

    nothing = (2, 0, 0)  # equal to no row, as its first part is neither true nor false
    before, held = nothing, None
    key_of = lambda t, i: tuple(t.column(c)[i].as_py() for c in (0, 1, 2))
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now.cast(held.schema)])
        if now.num_rows > 1:
            yield from judge(before, now.slice(0, now.num_rows - 1), key_of(now, now.num_rows - 1))
            before = key_of(now, now.num_rows - 2)
        held = now.slice(now.num_rows - 1)
    if held is not None:
        yield from judge(before, held, nothing)


def _cut_rows(units: Units):
    """Stage 3: the strings that have to be looked into, cut from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            wanted = batch.column(3).to_pylist()
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            held = 0
            for i, want in enumerate(wanted):
                strings = units.cut(data[at[i]:at[i + 1]].tobytes(), [x["start"] for x in want], [x["n"] for x in want])
                for x, s in zip(want, strings):
                    rows.append((x["m"], x["hot"], x["twin"], docs[i], tags[i], x["start"], x["n"], s))
                    held += len(s)
                    if held > 1 << 24:
                        yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=_CUT_SCHEMA)
                        rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=_CUT_SCHEMA)

    return run


_CUT = "m long, hot boolean, twin boolean, doc long, tag long, start long, n long, string binary"
_CUT_SCHEMA = pa.schema([("m", pa.int64()), ("hot", pa.bool_()), ("twin", pa.bool_()), ("doc", pa.int64()),
                         ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("string", pa.binary())])
_MARK = "doc long, tag long, a long, b long"
_MARK_SCHEMA = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _bucket_rows(find: Callable[[list[bytes]], list[list[tuple[int, int]]]], lot: int):
    """Stage 3 in a bucket: whole minimisers are gathered up to ``lot`` bytes and given to ``find``."""

    def marks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        got = find([r[4] for r in rows])
        out = [(d, t, s + a, s + b) for (d, t, s, twin, _), ranges in zip(rows, got) if not twin for a, b in ranges]
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=_MARK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("m", "doc", "tag", "start", "twin", "string"))):
                if size >= lot and r[0] != last:
                    yield from marks(rows)
                    rows, size = [], 0
                rows.append(r[1:])
                size, last = size + len(r[5]), r[0]
        if rows:
            yield from marks(rows)

    return run


_WINDOW = "done boolean, d binary, twin boolean, doc long, tag long, a long"
_WINDOW_SCHEMA = pa.schema([("done", pa.bool_()), ("d", pa.binary()), ("twin", pa.bool_()), ("doc", pa.int64()),
                            ("tag", pa.int64()), ("a", pa.int64())])


def _window_rows(units: Units, collapse: int):
    """Windows of the strings of an over-full minimiser, by 128-bit digests; equal ones of a lot are collapsed as in stage 1."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        place: dict[bytes, int] = {}
        again: set[int] = set()
        for i, r in enumerate(rows):
            first = place.setdefault(r[0], i)
            if first != i:
                again |= {first, i}
        out = [(False, d, i in again or rows[i][1], *rows[i][2:]) for d, i in place.items()]
        out += [(True, None, True, *rows[i][2:]) for i in sorted(again)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _WINDOW_SCHEMA.types)], schema=_WINDOW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, tag, start, n, twin, s in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "start", "n", "twin", "string"))):
                rows += [(xxhash.xxh3_128_digest(w), twin, doc, tag, start + i) for i, w in enumerate(units.windows(s, n))]
                if len(rows) > collapse:
                    yield settle(rows)
                    rows = []
        if rows:
            yield settle(rows)

    return run


def repeated_marks(texts: DataFrame, units: Units, find: Callable[[list[bytes]], list[list[tuple[int, int]]]], *,
                   collapse: int = 200_000, bucket_units: int = 1 << 20, lot: int = 1 << 20) -> DataFrame:
    """(doc, tag, a, b): unit ranges of documents that repeated windows cover. ``texts``: doc, tag, text."""
    texts = texts.select("doc", "tag", "text")
    probes = texts.mapInArrow(_probe_rows(units, collapse), _ROW)
    # settled rows are dealt by document, the others meet by minimiser
    dealt = probes.repartition(F.when(F.col("done"), F.xxhash64("doc", "start")).otherwise(F.col("m")))
    met = stash(dealt.sortWithinPartitions("done", "m", "dig").mapInArrow(_meet, _ROW + ", head boolean"), "superkmers")
    tail = F.lit(units.width - 1)
    whole = met.where("twin").select("doc", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") + tail).alias("b"))

    by_m = Window.partitionBy("m")
    heads = (met.where("head").withColumn("strings", F.count("*").over(by_m))
             .withColumn("open", F.max(~F.col("twin")).over(by_m))
             .withColumn("hot", F.sum(F.col("n") + tail).over(by_m) > F.lit(bucket_units))
             .where("open AND (strings > 1 OR own)"))
    wanted = heads.groupBy("doc", "tag").agg(F.collect_list(F.struct("m", "hot", "twin", "start", "n")).alias("want"))
    # two rows of one id and text give their strings twice, which is as often as these are there
    cut = stash(texts.join(wanted, ["doc", "tag"]).mapInArrow(_cut_rows(units), _CUT), "superkmer-strings")
    packed = cut.where("NOT hot").repartition("m").sortWithinPartitions("m")
    inside = packed.mapInArrow(_bucket_rows(find, lot), _MARK)

    windows = stash(cut.where("hot").mapInArrow(_window_rows(units, collapse), _WINDOW), "superkmer-windows")
    marks = lambda df: df.select("doc", "tag", "a", (F.col("a") + F.lit(units.width)).alias("b"))
    probe = windows.where("NOT done")
    again = probe.groupBy("d").agg(F.sum(F.when(F.col("twin"), 2).otherwise(1)).alias("c")).where("c > 1").select("d")
    spread = marks(windows.where("done")).union(marks(probe.where("NOT twin").join(again, "d")))
    return whole.union(inside).union(spread)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, doc, tag, text): ``doc`` hashes the id one to one and ``tag`` the text; neither is ever null."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).select(
        "doc_id", F.xxhash64("doc_id").alias("doc"), F.xxhash64("text").alias("tag"), "text")


def with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, marks) of every text (marks null: none)."""
    per = marks.groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    return texts.join(per, ["doc", "tag"], "left").select("doc_id", "text", "marks")


def covered(marks: list[dict] | None, size: int) -> np.ndarray:
    """Mask of the units that the marks cover."""
    step = np.zeros(size + 1, np.int64)
    if marks:
        np.add.at(step, [m["a"] for m in marks], 1)
        np.add.at(step, [m["b"] for m in marks], -1)
    return np.cumsum(step[:-1]) > 0
