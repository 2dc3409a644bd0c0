"""Private caches as keyed state: one cache per key inside the stream itself.

``stream_lookup`` keeps the cache as a table and replays whole micro-batches.
Here each key (e.g. a user) has its own state objects under
``transformWithStateInPandas``, so a batch reads the state of the keys it holds
and nothing else:

* ``waiting`` (``ListState``): requests whose event time the watermark has not
  passed. Rows of a micro-batch come in any order, so nothing is decided before;
* ``stored`` (``ListState``): the key's entries, vectors as float64 bytes. A value of either
  state holds up to ``PACK`` rows, as each value's way to and from Spark costs more than many rows do;
* event-time timers: one at the earliest waiting request. When it fires, the
  released requests are served in (event time, ``seq``) order, exactly like the
  sequential loop of ``operators/replay.py``.

Time-to-live (``ttl``): an entry stored at ``s`` serves requests before
``s + ttl``, in event time. A key that has no waiting request keeps a timer at
the end of its youngest entry, so the state of a key that went silent is freed.
Without ``ttl`` a key's state grows with its distinct questions for ever.

Bounds: a task holds the requests that one key has waiting (what arrives within
``delay`` and a micro-batch; ``maxFilesPerTrigger`` bounds the latter) and, with ``ttl``, the entries that can
still serve them, read and written once; without ``ttl`` stored entries are streamed past them in blocks. A key's requests depend on each other, so
one key is one task: where a key may hold a large share of all rows and no ``ttl``
bounds its entries, use ``stream_lookup`` with ``key``, which splits it over blocks.

Event times count in whole milliseconds, like Spark's watermark. A request more than
``delay`` behind the latest one seen is late and dropped by Spark. The last
requests wait until later ones move the watermark; with a ``delay`` of zero it
passes every request that has been read. Null and zero vectors match nothing, null
event times are refused, and a null key is a key of its own.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from nearhit.operators.cache import check_threshold
from nearhit.operators.vector_join import PLACES
from nearhit.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = 2048  # requests and entries compared at a time
PACK = 32  # rows in one value of a state; Spark hands over up to 10,000 values at a time
PACKED = "rows binary"  # waiting: query_id, seq, at, forced, fails, vector; stored: entry_id, at, is_seed, answered, vector
OUT = ("query_id string, seq long, outcome string, inserted boolean, matched_id string, matched_seed boolean, "
       "nearest_id string, nearest_is_seed boolean, distance double")


def _unit(v) -> bytes | None:
    """A vector's unit form as float64 bytes; null for null, zero and non-finite ones."""
    if v is None:
        return None
    x = np.asarray(v, np.float64)
    norm = np.linalg.norm(x)
    return (x / norm).tobytes() if np.isfinite(norm) and norm > 0 else None


def _units(vectors: list) -> list[bytes | None]:
    """``_unit`` of each vector, at once where all have one length."""
    known = [v for v in vectors if v is not None]
    if len({len(v) for v in known}) != 1:
        return [_unit(v) for v in vectors]
    x = np.array(known, np.float64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        norm = np.linalg.norm(x, axis=1)
        x /= norm[:, None]
    units = iter([u.tobytes() if good else None for u, good in zip(x, np.isfinite(norm) & (norm > 0))])
    return [None if v is None else next(units) for v in vectors]


def _matrix(vectors: list) -> np.ndarray:
    """Rows of vectors of one length, NaN rows for null ones."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    if any(len(v) != width for v in vectors if v is not None):
        raise ValueError("vectors of different lengths under one key")
    lost = np.full(width // 8, np.nan).tobytes()
    return np.frombuffer(b"".join(lost if v is None else v for v in vectors)).reshape(len(vectors), width // 8)


class _Best:
    """Nearest entry with and without a response, for each of a block of requests.

    The key of an entry is (distance, is_seed, id): ties go to a stored request, then to the smaller id (whole
    numbers compare as numbers)."""

    def __init__(self, n: int, numbers: bool):
        self.found, self.own = [[None, None] for _ in range(n)], int if numbers else str

    def offer(self, i: int, key: tuple, answered: bool) -> None:
        old = self.found[i][answered]
        if old is None or key < old:
            self.found[i][answered] = key

    def offer_all(self, dist: np.ndarray, entries: list[tuple]) -> None:
        """Each row's nearest of a block of entries; ``dist`` is infinite where an entry does not serve."""
        if not dist.size:
            return
        for answered in (False, True):
            cols = np.array([j for j, e in enumerate(entries) if e[3] == answered], int)
            if len(cols):
                part = dist if len(cols) == len(entries) else dist[:, cols]
                least = part.argmin(axis=1)
                low = part[np.arange(len(part)), least]
                lone = (part == low[:, None]).sum(axis=1) == 1
                for i in np.flatnonzero(np.isfinite(low)):
                    tied = cols[least[i:i + 1]] if lone[i] else cols[part[i] == low[i]]
                    self.offer(i, min((float(low[i]), entries[j][2], entries[j][0] if entries[j][2] else self.own(entries[j][0]))
                                      for j in tied.tolist()), answered)


def _distances(q: np.ndarray, e: np.ndarray, q_at: np.ndarray, e_at: np.ndarray, ttl: int | None) -> np.ndarray:
    if q.shape[1] and e.shape[1] and q.shape[1] != e.shape[1]:
        raise ValueError("vectors of different lengths under one key")
    if not (q.shape[1] and e.shape[1]):  # only null vectors on one side
        return np.full((len(q), len(e)), np.inf)
    d = np.round(1.0 - q @ e.T, PLACES)
    d[np.isnan(d)] = np.inf
    if ttl is not None:
        d[q_at[:, None] >= e_at[None, :] + ttl] = np.inf
    return d


def _chunks(rows, n: int):
    block = []
    for r in rows:
        block.append(r)
        if len(block) == n:
            yield block
            block = []
    if block:
        yield block


class _Packed:
    """A ``ListState`` of rows, ``PACK`` of them in a value."""

    def __init__(self, state):
        self.state = state

    def get(self) -> Iterator[tuple]:
        for value in self.state.get():
            yield from pickle.loads(value[0])

    def _values(self, rows) -> list[tuple]:
        return [(pickle.dumps(part),) for part in _chunks(rows, PACK)]

    def appendList(self, rows) -> None:
        self.state.appendList(self._values(rows))

    def put(self, rows) -> None:
        self.state.put(self._values(rows))

    def clear(self) -> None:
        self.state.clear()


class _Held:
    """The entries of a key while its requests are served, those whose time is over left out."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.changed = rows, False

    def get(self) -> list[tuple]:
        return self.rows

    def appendList(self, rows: list[tuple]) -> None:
        self.rows, self.changed = self.rows + rows, True

    def forget(self, born: int) -> None:
        """Keep the entries stored after ``born``."""
        live = [e for e in self.rows if e[1] > born]
        self.changed |= len(live) < len(self.rows)
        self.rows = live


class ReplayProcessor(StatefulProcessor):
    """One key's cache; see the module's docstring."""

    def __init__(self, threshold: float, ttl_ms: int | None, number_ids: bool):
        self.threshold, self.ttl, self.numbers = threshold, ttl_ms, number_ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Packed(handle.getListState("waiting", PACKED))
        self.stored = _Packed(handle.getListState("stored", PACKED))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        f = initialState
        rows = list(zip(map(str, f["entry_id"]), map(int, f["at"]), [True] * len(f), map(bool, f["answered"]), _units(f["embedding"].tolist())))
        if rows:
            self.stored.appendList(rows)
            self._watch_end(max(r[1] for r in rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            new = list(zip(map(str, f["query_id"]), map(int, f["seq"]), map(int, f["at"]), map(bool, f["forced"]), map(bool, f["fails"]),
                           _units(f["embedding"].tolist())))
            if new:
                self.waiting.appendList(new)
                low = min(r[2] for r in new)
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for r in self.waiting.get():
            (ready if r[2] <= now else later).append(r)
        if ready:
            ready.sort(key=lambda r: (r[2], r[1], r[0]))
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[2] for r in later))
            else:
                self.waiting.clear()
        if self.ttl is None:
            for block in _chunks(ready, BLOCK):
                yield self._serve(block, self.stored)
            return
        held = _Held(list(self.stored.get()))
        for block in _chunks(ready, BLOCK):
            held.forget(block[0][2] - self.ttl)  # no later request is earlier than the block's first
            yield self._serve(block, held)
        held.forget(now - self.ttl)  # waiting requests are later than ``now``, so none can use what is over by then
        if held.changed:
            if held.rows:
                self.stored.put(held.rows)
            else:
                self.stored.clear()
        if held.rows and not later:
            self._watch_end(max(e[1] for e in held.rows))

    def close(self) -> None:
        pass

    def _serve(self, block: list[tuple], stored=None) -> pd.DataFrame:
        """Outcomes of requests in order; what they store is appended to ``stored``, the state unless given."""
        stored_rows = self.stored if stored is None else stored
        best, q_at = _Best(len(block), self.numbers), np.array([r[2] for r in block])
        q = _matrix([r[5] for r in block])
        for entries in _chunks(stored_rows.get(), BLOCK):
            best.offer_all(_distances(q, _matrix([e[4] for e in entries]), q_at, np.array([e[1] for e in entries]), self.ttl), entries)
        among = _distances(q, q, q_at, q_at, self.ttl)
        out, new, n_new = [], np.empty(len(block), int), 0
        for i, (query_id, seq, at, forced, fails, vector) in enumerate(block):
            if forced:
                hit, near, served = False, None, None
            else:
                if n_new:
                    d = among[i, new[:n_new]]
                    if np.isfinite(low := d.min()):
                        best.offer(i, min((float(low), False, best.own(block[j][0])) for j in new[:n_new][d == low].tolist()), True)
                silent, served = best.found[i]
                hit = served is not None and served[0] < min(self.threshold, silent[0] if silent else self.threshold)
                near = min((x for x in (silent, served) if x is not None), default=None)
            inserted = not hit and not fails
            if inserted:
                new[n_new] = i
                n_new += 1
            d, seed, nid = (near[0], near[1], str(near[2])) if near else (None, None, None)
            out.append((query_id, seq, "forced" if forced else "hit" if hit else "miss", inserted,
                        nid if hit else None, seed if hit else None, nid, seed, d))
        if n_new:
            stored_rows.appendList([(block[i][0], block[i][2], False, True, block[i][5]) for i in new[:n_new].tolist()])
        # object columns keep their nulls as nulls and their booleans as booleans
        kinds = {"seq": "int64", "distance": "float64"}
        return pd.DataFrame({c: pd.Series(part, dtype=kinds.get(c, object)) for c, part in zip((c.split()[0] for c in OUT.split(", ")), zip(*out))})

    def _watch_end(self, at: int) -> None:
        if self.ttl is not None:
            self.handle.registerTimer(at + self.ttl)


def _key(key: list[str]):
    return F.to_json(F.struct(*key)).alias("_key")


def stream_replay_keyed(spark: SparkSession, requests_stream: DataFrame, threshold: float, key: list[str], *,
                        time_col: str = "ts", delay: str = "0 seconds", ttl: str | None = None,
                        seeds: DataFrame | None = None, seed_time_col: str | None = None,
                        base_dir: str | None = None) -> DataFrame:
    """Serve a stream of requests from one cache per key and return the outcome table.

    ``requests_stream``: ``query_id, seq, embedding``, the ``key`` columns, the
    event time ``time_col`` and, if wanted, ``force`` and ``fail`` (the provider call fails: a
    miss that stores nothing). ``seeds``: entries present before the stream,
    ``entry_id, embedding, llm_response`` and the key; one without a response turns nearer hits into
    misses. Seeds count as stored at ``seed_time_col``, or at 1970 without one, and expire like other entries.
    ``ttl``: an interval such as ``'2 hours'``; without one entries never expire.

    Returns the columns of ``cache_replay``, ids as strings. ``base_dir`` names the stream's
    folder: a later call with the same one goes on from its checkpoint, and seeds count
    in the first call only. All requests read so far that the watermark has passed are served.
    """
    threshold = check_threshold(threshold)
    if not key:
        raise ValueError("keyed replay needs at least one key column")
    ttl_ms = None
    if ttl is not None:
        ttl_ms = spark.range(1).select((F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {ttl}"))).alias("t")).first()["t"]
        if ttl_ms <= 0:
            raise ValueError(f"ttl must be positive: {ttl}")
    base = base_dir or f"{ensure_checkpoint_dir(spark)}/stream-keyed-{uuid.uuid4().hex}"
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in requests_stream.columns else F.lit(False)
    at = F.date_trunc("MILLISECOND", F.col(time_col))
    at = F.when(at.isNull(), F.raise_error("a request without an event time")).otherwise(at)
    asked = (requests_stream.select(_key(key), F.col("query_id").cast("string").alias("query_id"), "seq", at.alias("_at"),
                                    flag("force").alias("forced"), flag("fail").alias("fails"), "embedding")
             .withWatermark("_at", delay).withColumn("at", F.unix_millis("_at")))
    numbers = isinstance(requests_stream.schema["query_id"].dataType, IntegralType)
    initial = None
    if seeds is not None:
        born = F.unix_millis(F.col(seed_time_col)) if seed_time_col else F.lit(0).cast("long")
        initial = seeds.select(_key(key), F.col("entry_id").cast("string").alias("entry_id"), born.alias("at"),
                               F.col("llm_response").isNotNull().alias("answered"), "embedding").groupBy("_key")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only one with keyed state objects
    try:
        served = asked.groupBy("_key").transformWithStateInPandas(
            ReplayProcessor(threshold, ttl_ms, numbers), OUT, "append", "EventTime", initialState=initial)
        q = (served.writeStream.format("parquet").option("path", f"{base}/outcomes").option("checkpointLocation", f"{base}/_checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)  # a started query keeps its own copy
    q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/outcomes")
