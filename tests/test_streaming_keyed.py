"""Keyed streaming state: equal to the batch replay, to a plain loop with expiry, and unchanged by a restart."""

import datetime as dt
import os
import random
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nearhit.operators.replay import cache_replay
from nearhit.session import ensure_checkpoint_dir
from nearhit.streaming import keyed as K

DDL = "query_id long, seq long, ts timestamp, user string, force boolean, fail boolean, embedding array<float>"
SEED_DDL = "user string, entry_id string, embedding array<float>, llm_response string"
START = dt.datetime(2024, 1, 1)


def base_dir(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"k-{uuid.uuid4().hex}")


def requests(n=120, seed=5):
    """Rows in time order; repeated vectors, forced and failing requests, null keys, null and zero vectors."""
    rng = random.Random(seed)
    vecs = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(10)] + [None, [0.0] * 4]
    return [(i, i, START + dt.timedelta(minutes=i), rng.choice(["a", "a", "b", None]), rng.random() < 0.05, rng.random() < 0.2,
             vecs[rng.randrange(12)]) for i in range(n)]


def seed_rows(seed=6):
    rng = random.Random(seed)
    return [(u, f"s{i}{u}", [rng.uniform(-1, 1) for _ in range(4)], rng.choice([None, "r"])) for u in ("a", None, "quiet") for i in range(3)]


def append(spark, rows, path):
    """Each list of rows becomes one file, so one micro-batch."""
    for part in rows:
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times


def stream(spark, path):
    return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)


def loop(rows, threshold, seeds=(), ttl=None):
    """The sequential loop for every key, one request at a time."""
    store, out = {}, []
    for u, eid, v, resp in seeds:
        store.setdefault(u, []).append((eid, dt.datetime(1970, 1, 1), True, resp is not None, v))

    def distance(a, b):
        a, b = (None if x is None else np.array(x, np.float32).astype(float) for x in (a, b))
        if a is None or b is None or not a.any() or not b.any():
            return None
        return round(1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b)), 9)

    for q, _, ts, u, force, fail, v in sorted(rows, key=lambda r: (r[2], r[1])):
        mine, hit, near = store.setdefault(u, []), False, None
        if not force:
            live = [(distance(v, e[4]), e[2], e[0] if e[2] else int(e[0]), e[3]) for e in mine if ttl is None or ts < e[1] + ttl]
            live = sorted(x for x in live if x[0] is not None)
            near = live[0] if live else None
            silent = min((x[0] for x in live if not x[3]), default=threshold)
            hit = any(x[3] and x[0] < min(threshold, silent) for x in live)
        if not hit and not fail:
            mine.append((str(q), ts, False, True, v))
        out.append((str(q), "forced" if force else "hit" if hit else "miss", not hit and not fail, str(near[2]) if near else None))
    return sorted(out)


def outcomes(df):
    return sorted(tuple(r) for r in df.select("query_id", "outcome", "inserted", "nearest_id").collect())


def test_equals_batch_replay_and_loop_with_seeds(spark):
    base, rows = base_dir(spark), requests()
    mixed = [rows[:50], rows[50:90], rows[90:]]
    for part in mixed:
        random.Random(1).shuffle(part)  # a batch's rows come in any order
    append(spark, mixed, f"{base}/in")
    seeds = spark.createDataFrame(seed_rows(), SEED_DDL)
    got = K.stream_replay_keyed(spark, stream(spark, f"{base}/in"), 0.3, ["user"], seeds=seeds, base_dir=base)
    want = cache_replay(spark.createDataFrame(rows, DDL), 0.3, seeds, key=["user"], fail_col="fail")
    assert outcomes(got) == outcomes(want.withColumn("query_id", F.col("query_id").cast("string"))) == loop(rows, 0.3, seed_rows())
    near = {r["query_id"]: r["distance"] for r in got.collect()}
    assert all(near[str(r["query_id"])] == pytest.approx(r["distance"], abs=1e-9) if r["distance"] is not None
               else near[str(r["query_id"])] is None for r in want.collect())


def test_restart_goes_on_from_the_checkpoint(spark):
    base, rows = base_dir(spark), requests(seed=8)
    append(spark, [rows[:40]], f"{base}/in")
    first = outcomes(K.stream_replay_keyed(spark, stream(spark, f"{base}/in"), 0.3, ["user"], base_dir=base))
    assert first == loop(rows[:40], 0.3)
    assert outcomes(K.stream_replay_keyed(spark, stream(spark, f"{base}/in"), 0.3, ["user"], base_dir=base)) == first
    append(spark, [rows[40:80], rows[80:]], f"{base}/in")
    assert outcomes(K.stream_replay_keyed(spark, stream(spark, f"{base}/in"), 0.3, ["user"], base_dir=base)) == loop(rows, 0.3)


def test_entries_expire_and_quiet_keys_free_their_state(spark):
    base, rows = base_dir(spark), requests(150, seed=9)
    last = rows[-1][2] + dt.timedelta(hours=9)
    rows.append((999, 999, last, "z", False, False, [1.0, 0.0, 0.0, 0.0]))
    append(spark, [rows[:70], rows[70:150], rows[150:]], f"{base}/in")
    got = outcomes(K.stream_replay_keyed(spark, stream(spark, f"{base}/in"), 0.3, ["user"], ttl="25 minutes", base_dir=base))
    assert got == loop(rows, 0.3, ttl=dt.timedelta(minutes=25))
    assert got != loop(rows, 0.3)
    left = (spark.read.format("statestore").option("stateVarName", "stored").load(f"{base}/_checkpoint").select("key").distinct().count())
    assert left == 1  # only the last request's key still holds an entry


def test_out_of_order_requests_within_the_delay(spark):
    base, rows = base_dir(spark), requests(60, seed=10)
    early, late = rows[:40:2] + rows[40:], rows[1:40:2]  # the second file is behind the first, within the delay
    end = [(500, 500, START + dt.timedelta(days=2), "end", False, False, [1.0, 0.0, 0.0, 0.0])]
    append(spark, [early, late, end], f"{base}/in")
    got = K.stream_replay_keyed(spark, stream(spark, f"{base}/in"), 0.3, ["user"], delay="2 hours", base_dir=base)
    assert outcomes(got) == loop(rows, 0.3)  # the last request still waits for the watermark


def test_blocks_do_not_change_the_result(monkeypatch):
    rows = [(f"q{i}", i, i, False, False, K._unit([1.0, i % 7])) for i in range(40)]

    class Store(list):
        get, appendList = list.__iter__, list.extend

    def run(block):
        monkeypatch.setattr(K, "BLOCK", block)
        p = K.ReplayProcessor(0.01, 9, False)
        p.stored = Store([("s", 0, True, False, K._unit([1.0, 3.1]))])
        parts = [p._serve(b) for b in K._chunks(rows, block)]
        return [tuple(map(str, r)) for part in parts for r in part.itertuples(index=False)]

    assert run(3) == run(64)


class FakeHandle:
    """Keeps states and timers as Spark does and counts the values that go to and fro."""

    def __init__(self):
        self.states, self.timers, self.calls, self.values = {}, set(), 0, 0

    def getListState(self, name, schema):
        handle, kept = self, self.states.setdefault(name, [])

        class State:
            def get(self):
                handle.calls += 1
                handle.values += len(kept)
                return iter(list(kept))

            def appendList(self, rows):
                handle.calls += 1
                handle.values += len(rows)
                kept.extend(rows)

            def put(self, rows):
                kept.clear()
                self.appendList(rows)

            def clear(self):
                handle.calls += 1
                kept.clear()

            def exists(self):
                handle.calls += 1
                return bool(kept)
        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_key_costs_few_values_of_state(monkeypatch):
    """Rows travel many to a value, the entries of a key with ``ttl`` once a timer, and expired ones leave the state."""
    monkeypatch.setattr(K, "BLOCK", 40)
    rows = [(*r[:3], "a", *r[4:]) for r in requests(300, seed=12)]
    ms = lambda ts: int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    ttl = 25 * 60000
    handle, p = FakeHandle(), K.ReplayProcessor(0.3, ttl, True)
    p.init(handle)
    out, mid = [], ms(rows[149][2])
    frame = pd.DataFrame({"query_id": [str(r[0]) for r in rows], "seq": [r[1] for r in rows], "at": [ms(r[2]) for r in rows],
                          "forced": [r[4] for r in rows], "fails": [r[5] for r in rows],
                          "embedding": pd.Series([None if r[6] is None else np.array(r[6], np.float32) for r in rows], dtype=object)})
    assert not [f for f in p.handleInputRows(("a",), iter([frame]), Clock(0)) if len(f)]
    for now in (mid, ms(rows[-1][2]), ms(rows[-1][2]) + ttl):
        out += [tuple(r) for f in p.handleExpiredTimer(("a",), Clock(now), None)
                for r in f[["query_id", "outcome", "inserted", "nearest_id"]].itertuples(index=False)]
    assert sorted(out) == loop(rows, 0.3, ttl=dt.timedelta(milliseconds=ttl))
    assert handle.values < len(rows) // 4 and handle.calls < 20 and handle.states["stored"] == [] == handle.states["waiting"]


def test_units_at_once_equal_one_by_one():
    rng = np.random.default_rng(3)
    v = [*rng.normal(size=(50, 64)).astype(np.float32), None, np.zeros(64, np.float32), np.full(64, np.inf, np.float32), np.full(64, np.nan)]
    for vectors in (v, [*v, np.ones(3)], [None], []):
        for one, many in zip([K._unit(x) for x in vectors], K._units(vectors), strict=True):
            assert one is many is None or np.allclose(np.frombuffer(one), np.frombuffer(many), rtol=1e-14, atol=0)


def test_bad_input_is_refused(spark):
    with pytest.raises(ValueError, match="key"):
        K.stream_replay_keyed(spark, spark.createDataFrame([], DDL), 0.3, [])
    with pytest.raises(ValueError, match="lengths"):
        K._matrix([K._unit([1.0]), K._unit([1.0, 2.0])])
    assert K._unit([float("nan")]) is None and K._matrix([None, None]).shape == (2, 0)
