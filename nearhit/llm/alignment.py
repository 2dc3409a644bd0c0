"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over a corpus."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhit.llm.common import stash

# Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cuts that neither vocabulary has a token across: a single blank between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, their tokens' bytes, and the identity map: the B id of the same bytes for each A id, or -1."""

    _loaded: dict[tuple, Vocabularies] = {}

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in told.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in told["model"]["merges"]]
        order = [ranks[bytes(alphabet[c] for c in m.replace(" ", ""))] for m in merges]
        if told["pre_tokenizer"]["type"] != "ByteLevel" or order != sorted(order):
            raise ValueError(f"{a_path}: not a byte-level BPE whose ids follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b_path}: a piece holds a blank after another character")
        self.b_bytes = [b"" if self.b.is_control(i) or self.b.is_unknown(i)
                        else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], np.int64)
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(size), key=lambda i: (self.b.is_byte(i), i)):
            if self.b_bytes[i]:
                by_bytes.setdefault(self.b_bytes[i], i)
        self.same = np.array([by_bytes.get(t, -1) if t else -1 for t in self.a_bytes], np.int64)
        self.names = [[f"{i}{sep}".encode() for i in range(max(size, len(self.a_bytes)))] for sep in ",|;"]

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Vocabularies:
        """One pair a Python worker."""
        key = (a_path, b_path)
        if key not in cls._loaded:
            cls._loaded[key] = cls(a_path, b_path)
        return cls._loaded[key]

    def encode_a(self, units: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all units one after the other, ids of each unit). Units that begin and end as ``CUT`` asks are encoded together."""
        flat: list[int] = []
        count = []
        lot: list[str] = []

        def settle() -> None:
            ids = self.a.encode_ordinary("".join(lot))
            ends = np.cumsum(self.a_len[ids])
            at = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in lot]), side="left") + 1
            count.extend(np.diff(np.concatenate(([0], at))).tolist())
            flat.extend(ids)
            lot.clear()

        for u in units:
            if len(u) > 1 and not u[1].isspace() and not u[-1].isspace():
                lot.append(u)
                if len(lot) == 256:
                    settle()
                continue
            if lot:
                settle()
            ids = self.a.encode_ordinary(u)
            count.append(len(ids))
            flat.extend(ids)
        if lot:
            settle()
        return flat, count

    def encode_b(self, units: list[str]) -> tuple[list[int], list[int]]:
        ids = self.b.encode([u[1:] for u in units], num_threads=1)
        return [i for x in ids for i in x], [len(x) for x in ids]


def _whole(ids: list[int], count: list[int], names: list[bytes], units: list[bytes]) -> np.ndarray:
    """Which units the ids' bytes spell exactly."""
    if b"".join(map(names.__getitem__, ids)) == b"".join(units):
        size = np.array([len(names[i]) for i in ids], np.int64)
        got = np.add.reduceat(np.append(size, 0), np.concatenate(([0], np.cumsum(count)[:-1]))) if len(units) else size
        if (got == [len(u) for u in units]).all() and min(count, default=1) > 0:
            return np.ones(len(units), bool)
    good, at = np.zeros(len(units), bool), 0
    for k, (u, n) in enumerate(zip(units, count)):
        good[k] = b"".join(names[i] for i in ids[at:at + n]) == u
        at += n
    return good


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _tally(*keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct key tuples in order and the sum of their weights."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    weight = np.ones(len(order), np.int64) if weight is None else weight[order]
    return [k[at] for k in keys], np.add.reduceat(weight, at) if len(at) else weight[:0]


class Units:
    """What the distinct units of some texts are made of: counts, links and the groups' spelling.

    A unit is " " and text up to the next ``CUT``. At most ``most`` units are kept between lots."""

    def __init__(self, voc: Vocabularies, most: int):
        self.voc, self.most = voc, most
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.numbers = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, spelled exactly
        # flat (id or pair, links) of the units' identity groups and irregular groups, each with its units' bounds
        self.lists = [[np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in range(2)]

    def learn(self, units: list[str]) -> None:
        voc, raw = self.voc, [u.encode() for u in units]
        (a, na), (b, nb) = voc.encode_a(units), voc.encode_b(units)
        good = _whole(a, na, voc.a_bytes, raw) & _whole(b, nb, voc.b_bytes, raw)
        a, b = np.array(a, np.int64)[np.repeat(good, na)], np.array(b, np.int64)[np.repeat(good, nb)]
        na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        unit_end = np.cumsum(np.where(good, [len(u) for u in raw], 0))
        end_a, end_b = np.cumsum(voc.a_len[a]), np.cumsum(voc.b_len[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        ga, gb = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
        unit = np.searchsorted(unit_end, common)  # a unit that is not good has no byte, so no end falls on it first
        first_a, first_b = np.cumsum(ga) - ga, np.cumsum(gb) - gb

        one = (ga == 1) & (gb == 1)
        one[one] = voc.same[a[first_a[one]]] == b[first_b[one]]
        odd_a, odd_b = ~one[in_a], ~one[in_b]
        (g, ida), times = _tally(in_a[odd_a], a[odd_a])
        (h, idb), times_b = _tally(in_b[odd_b], b[odd_b])
        width = np.searchsorted(h, g, side="right") - np.searchsorted(h, g)
        take = spread(np.searchsorted(h, g), width)
        pa_, pb, links, of = np.repeat(ida, width), idb[take], np.repeat(times, width) * times_b[take], np.repeat(unit[g], width)
        equal = voc.same[pa_] == pb  # the identity pair inside an irregular group is counted with the others
        found = [_tally(np.concatenate((unit[one], of[equal])), np.concatenate((a[first_a[one]], pa_[equal])),
                        weight=np.concatenate((np.ones(int(one.sum()), np.int64), links[equal]))),
                 _tally(of[~equal], pa_[~equal] * len(voc.b_bytes) + pb[~equal], weight=links[~equal])]
        for held, ((u, key), weight) in zip(self.lists, found):
            bounds = np.searchsorted(u, np.arange(len(units)), side="right")
            held[0] = np.concatenate((held[0], bounds + held[0][-1]))
            held[1], held[2] = np.concatenate((held[1], key)), np.concatenate((held[2], weight))
        sums = [np.bincount(unit, w, len(units)).astype(np.int64) for w in (ga, gb, np.ones(len(common)), ga * gb)]
        self.numbers = np.concatenate((self.numbers, np.stack([*sums, good.astype(np.int64)], axis=1)))

        # the spelling a1,a2|b1; of each group: tokens in order of (group, side), each with the sign that follows it
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[(first_a + ga - 1)[ga > 0]] = last_b[(first_b + gb - 1)[gb > 0]] = True
        ids = np.concatenate((a, b))
        sign = np.concatenate((last_a * 1, last_b * 2))
        order = np.argsort(np.concatenate((2 * in_a, 2 * in_b + 1)), kind="stable")
        signs, names = sign[order].tolist(), voc.names
        parts = [names[s][i] for s, i in zip(signs, ids[order].tolist())]
        at = 0
        for n in (na + nb).tolist():
            self.spelled.append(b"".join(parts[at:at + n]))
            at += n

    def lot(self, texts: list[str | None]) -> list[pa.Array]:
        """The counts, digest and lists of each text."""
        if len(self.codes) > self.most:
            self.clear()
        rows, codes = [], self.codes
        known = len(codes)
        for t in texts:
            pieces = CUT.split(" " + t) if t else []
            units = [pieces[0], *[" " + p for p in pieces[1:]]] if pieces else []
            rows.append(np.fromiter((codes.setdefault(u, len(codes)) for u in units), np.int64, len(units)))
        if len(codes) > known:
            new = [u for u, _ in zip(reversed(codes), range(len(codes) - known))]
            self.learn(new[::-1])
        size = np.array([len(r) for r in rows])
        doc, unit = np.repeat(np.arange(len(rows)), size), np.concatenate([*rows, np.zeros(0, np.int64)])
        fine = np.bincount(doc, 1 - self.numbers[unit, 4], len(rows)) == 0
        digest = []
        for r, ok in zip(rows, fine.tolist()):
            text = b"".join(map(self.spelled.__getitem__, r.tolist())) if ok and len(r) else b""
            digest.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        keep = fine[doc]
        doc, unit = doc[keep], unit[keep]
        sums = [np.bincount(doc, self.numbers[unit, k], len(rows)).astype(np.int64) for k in range(4)]
        (doc, unit), times = _by(doc, unit)
        lists = []
        for bounds, key, links in self.lists:
            count = bounds[unit + 1] - bounds[unit]
            take = spread(bounds[unit], count)
            (d, k), weight = _by(np.repeat(doc, count), key[take], np.repeat(times, count) * links[take])
            offsets = pa.array(np.searchsorted(d, np.arange(len(rows) + 1)).astype(np.int32))
            lists += [pa.ListArray.from_arrays(offsets, pa.array(k)), pa.ListArray.from_arrays(offsets, pa.array(weight))]
        return [pa.array(x) for x in sums] + [pa.array(digest, pa.string())] + lists


def _by(doc: np.ndarray, key: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """``_tally`` of (doc, key), by one sort where both fit 63 bits together."""
    span = int(key.max(initial=0)) + 1
    if (int(doc.max(initial=0)) + 1) * span >= 1 << 63:
        return _tally(doc, key, weight=weight)
    (both,), total = _tally(doc * span + key, weight=weight)
    return [both // span, both % span], total


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
LISTS = ("same", "same_links", "pairs", "pair_links")


def linked(docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text",
           lot_chars: int = 1 << 22, most: int = 300_000) -> DataFrame:
    """One row a document: ``row``, doc_id, the counts, groups_sha256 and its distinct links.

    ``same``: ids of A linked to the B token of the same bytes, ``pairs``: the
    other links as A id * B's vocabulary + B id, both with their number of
    occurrences. Texts are encoded unit by unit, each distinct unit of a lot once."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, row = Units(Vocabularies.of(a_path, b_path), most), TaskContext.get().partitionId() << 40
        for batch in batches:
            size = np.cumsum([0, *[len(t) if t else 0 for t in batch.column(1).to_pylist()]])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, size[at] + lot_chars, side="right")) - 1)
                got = units.lot(batch.column(1).slice(at, end - at).to_pylist())
                ids = pa.array(np.arange(row, row + end - at))
                yield pa.record_batch([ids, batch.column(0).slice(at, end - at), *got], names=["row", "doc_id", *NUMBERS, "groups_sha256", *LISTS])
                row, at = row + end - at, end

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups_sha256 string, "
                           + ", ".join(f"{c} array<long>" for c in LISTS))


def pair_counts(links: DataFrame, a_path: str, b_path: str, flush: int = 1 << 21) -> DataFrame:
    """(a, b, n): in how many documents each pair is linked.

    Identity pairs are counted in one vector of A's vocabulary a task, of
    which each task sends its non-zero places; only the pairs of irregular
    groups are sent as pairs, summed over the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabularies.of(a_path, b_path)
        vector, held, size, width = np.zeros(len(voc.a_bytes), np.int64), [], 0, len(voc.b_bytes)

        def sent(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(pair // width), pa.array(pair % width), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(vector))
            pair, n = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            held.append((pair, n))
            size += len(pair)
            if size > flush:
                (pair,), n = _tally(np.concatenate([p for p, _ in held]), weight=np.concatenate([n for _, n in held]))
                held, size = [(pair, n)], len(pair)
                if size > flush // 2:
                    yield sent(pair, n)
                    held, size = [], 0
        if held:
            (pair,), n = _tally(np.concatenate([p for p, _ in held]), weight=np.concatenate([n for _, n in held]))
            yield sent(pair.astype(np.int64), n.astype(np.int64))
        a = np.flatnonzero(vector)
        yield sent(a * width + voc.same[a], vector[a])

    got = links.select("same", "pairs").mapInArrow(run, "a long, b long, n long")
    return got.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text", hot: int = 1 << 17) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes " " and the text, B the text with the blank that it adds itself.
    Byte offsets where tokens of both end cut them into groups, and every A
    token of a group is linked to every B token of it. A pair's count is the
    number of rows of ``docs`` that hold it linked; n_best counts the links
    whose count is the highest of their A id (ties included), count_sum sums the counts of all links.

    Null and empty texts, and texts that either side does not spell exactly
    (such as a literal U+2581), have no tokens: zeros and ''. Repeated rows
    and null ids are documents of their own; other columns are ignored. An empty table gives no rows.

    Three bounded tables are broadcast: the identity pairs' counts and each A
    id's highest count (vectors of A's vocabulary), and the at most ``hot`` most
    frequent other pairs. Only links to rarer pairs meet their counts in a
    shuffle, so no key of that join has many rows."""
    spark = docs.sparkSession
    links = stash(linked(docs, a_path, b_path, doc_id=doc_id, text=text), "align-links")
    counts = stash(pair_counts(links, a_path, b_path), "align-counts")
    voc = Vocabularies.of(a_path, b_path)
    width, size = len(voc.b_bytes), len(voc.a_bytes)
    best, same_n = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for a, n in counts.groupBy("a").agg(F.max("n")).collect():  # at most A's vocabulary
        best[a] = n
    identity = spark.createDataFrame([(int(a), int(b)) for a, b in enumerate(voc.same) if b >= 0], "a long, b long")
    for a, n in counts.join(F.broadcast(identity), ["a", "b"]).select("a", "n").collect():
        same_n[a] = n
    other = counts.join(F.broadcast(identity), ["a", "b"], "left_anti")
    top = other.select("n").orderBy(F.desc("n")).limit(hot + 1).agg(F.min("n"), F.count("*")).first()
    floor = top[0] if top[1] > hot else 0  # pairs above it are few enough to be sent
    found = other.where(F.col("n") > floor).select("a", "b", "n").toArrow()
    code = found["a"].to_numpy() * width + found["b"].to_numpy()
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast({
        "best": best, "same_n": same_n, "code": code[order], "n": found["n"].to_numpy()[order]})

    def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of pairs, which of them are among the frequent ones)."""
        got = shared.value
        if not len(got["code"]):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(got["code"], key), len(got["code"]) - 1)
        hit = got["code"][at] == key
        return np.where(hit, got["n"][at], 0), hit

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return (column.flatten().to_numpy(zero_copy_only=False),
                np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value
            part = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            ids, doc = flat(part["same"])
            links = flat(part["same_links"])[0]
            total = np.zeros(batch.num_rows, np.int64)
            good = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, doc, links * got["same_n"][ids])
            np.add.at(good, doc, links * (got["same_n"][ids] == got["best"][ids]))
            key, doc = flat(part["pairs"])
            links = flat(part["pair_links"])[0]
            n, hit = counted(key)
            np.add.at(total, doc, links * n)
            np.add.at(good, doc, links * (hit & (n == got["best"][key // width])))
            yield pa.record_batch([*[part[c] for c in ("row", "doc_id", *NUMBERS, "groups_sha256")], pa.array(good), pa.array(total)],
                                  names=["row", "doc_id", *NUMBERS, "groups_sha256", "best", "total"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc = flat(batch.column(1))
            _, hit = counted(key)
            row = batch.column(0).to_numpy(zero_copy_only=False)
            key, doc, links = key[~hit], doc[~hit], flat(batch.column(2))[0][~hit]
            for at in range(0, len(key), 1 << 18):
                s = slice(at, at + (1 << 18))
                yield pa.record_batch([pa.array(row[doc[s]]), pa.array(key[s] // width), pa.array(key[s] % width), pa.array(links[s])],
                                      names=["row", "a", "b", "links"])

    kind = dict(links.dtypes)["doc_id"]
    numbers = ", ".join(f"{c} long" for c in NUMBERS)
    head = links.mapInArrow(heads, f"row long, doc_id {kind}, {numbers}, groups_sha256 string, best long, total long")
    highest = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a long, most long")
    late = links.select("row", "pairs", "pair_links").mapInArrow(rare, "row long, a long, b long, links long")
    late = late.join(other.where(F.col("n") <= floor), ["a", "b"]).join(F.broadcast(highest), "a")
    late = late.groupBy("row").agg(F.sum(F.col("links") * F.col("n")).alias("more"),
                                   F.sum(F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0)).alias("more_best"))
    return head.join(late, "row", "left").select(
        "doc_id", *NUMBERS, (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
