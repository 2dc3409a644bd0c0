"""The corpus pipeline against brute force, and that the rest of the library does without this subpackage."""

import random
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from nearhit.llm import pii
from nearhit.llm.queries import PII_KEY, QUERIES, tokenizer_path

from test_llm_mix_pack import level_targets
from test_llm_rules_pii import verdicts
from test_llm_search_simhash import classes, plain_fingerprint

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(200)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, line(rng.choice([5, 25, 60, 200])), "en", rng.choice(["a", "a", "b", "c", None])) for i in range(200)]
    rows += [(300 + i, rows[i][1], "en", "copies") for i in range(60)]
    rows += [(400 + i, rows[i][1] + f" mail x{i}.lee@exam.org ip 10.0.0.{i}", "en", "a") for i in range(20)]
    rows += [(500 + i, "junk", "en", "bad") for i in range(40)] + [(560, line(40), "en", "bad"), (600, None, None, "a"), (601, "", "en", None),
             (7, rows[7][1], "en", rows[7][3]), (None, line(30), "en", "a")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def stages(spark):
    from nearhit.llm.common import stash
    docs = spark.createDataFrame(corpus(), DDL).repartition(4)
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stash(stage(spark, out[-1], "/nowhere"), "test"))
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_all_but_the_last_return_the_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])
    assert [n for n, _ in P.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources to target weights", "packing"]


def test_quality_stage(stages):
    rows = rows_of(stages[0])
    kept = verdicts([(r[3], r[1]) for r in rows], 0.8)
    assert sorted(map(str, rows_of(stages[1]))) == sorted(str(r) for r, k in zip(rows, kept) if k)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = rows_of(stages[1])
    fps = sorted({plain_fingerprint(r[1]) for r in rows})
    arr = np.array(fps, np.uint64)
    pairs = [(fps[i], fps[i + 1 + int(j)]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3)]
    root = classes(fps, pairs)
    best = {}
    for r in rows:
        k = root[plain_fingerprint(r[1])]
        key = (r[0] is None, r[0] or 0)
        best[k] = min(best.get(k, key), key)
    kept = rows_of(stages[2])
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == sorted(best.values())
    assert set(map(str, kept)) <= set(map(str, rows))


def test_pii_stage_changes_values_only(spark, stages):
    before = {r[0]: r for r in rows_of(stages[2])}
    after = {r[0]: r for r in rows_of(stages[3])}
    assert before.keys() == after.keys()
    want = {r.doc_id: r.text for r in pii.pseudonymise(stages[2], key=PII_KEY).collect()}
    for i, r in after.items():
        assert r[1] == want[i] and r[4] == len(r[1]) and r[2:4] == before[i][2:4]
        assert not re.search(r"x\d+\.lee@exam|10\.0\.0\.", r[1])


def test_mixing_stage_meets_targets(stages):
    rows, mixed = rows_of(stages[3]), rows_of(stages[4])
    size = lambda t: len((t or "").split())
    sizes, got, whole = defaultdict(int), defaultdict(int), {r[0]: r for r in rows}
    for r in rows:
        sizes[r[3]] += size(r[1])
    for r in mixed:
        got[r[3]] += size(r[1])
        full = whole[r[0]]
        assert r[1] == full[1] or full[1].split()[:size(r[1])] == r[1].split()
        assert r[4] == len(r[1])
    want = level_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 0.5 for s in sizes)


def test_packing_stage_round_trip(stages):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    texts = defaultdict(list)
    for r in rows_of(stages[4]):
        texts[r[0]].append(np.array(t.encode(r[1], add_special_tokens=False).ids + [2]))
    pieces = stages[5].collect()
    got = defaultdict(int)
    for r in pieces:
        assert any(zlib.crc32(x[r.start:r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
        got[r.doc_id] += r.length
    assert got == {i: sum(map(len, x)) for i, x in texts.items()}
    seqs = defaultdict(int)
    for r in pieces:
        seqs[r.sequence_id] += r.length
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in seqs.values())


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], DDL)
    for _, stage in P.STAGES:
        out = stage(spark, docs, "/nowhere")
        assert out.count() == 0


def test_run_equals_the_stages(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_the_rest_imports_nothing_of_it():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, '.')\n"
            "import importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline',) or name.startswith('nearhit.llm'):\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name if name == 'corpus_pipeline' else 'nearhit.llm')\n"
            "sys.modules.pop('corpus_pipeline'); sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as E; q = E.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); E.oracle_sql(); print('fine')")
    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert got.stdout.strip().endswith("fine"), got.stderr




def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the stages' own, one text under two sources, and rows that differ in another column only."""
    import corpus_pipeline

    names = ("row", "made", "doc", "tag", "host", "bad_host", "shard", "size", "_new", "_f", "_base", "_doc", "_tag", "_shard", "_size", "place", "length")
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(i, t, s, *[f"{n}{i}" for n in names]) for i, (t, s) in enumerate([(text, "a"), (other, "b"), (other + " mail a.b@example.org", "a"), (text, "b")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(map(tuple, good.collect())) == sorted(rows) and good.columns == docs.columns
    one = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {tuple(r) for r in one} < set(rows) and {r["doc_id"] for r in one} >= {0, 1}
    for r in corpus_pipeline.pseudonyms(spark, docs, "").collect():
        assert tuple(r)[2:] == rows[r["doc_id"]][2:] and (r["text"] == rows[r["doc_id"]][1]) == (r["doc_id"] != 2)
    mixed = corpus_pipeline.mix_sources(spark, docs.withColumn("doc_id", F.lit(5).cast("long")), "").collect()
    by = {(r["source"], r["text"].split(" ")[0], r["_new"]) for r in mixed}
    assert by == {("a", "word0", "_new0"), ("b", "other0", "_new1"), ("a", "other0", "_new2"), ("b", "word0", "_new3")}
