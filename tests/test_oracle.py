"""Registered queries against their DuckDB twins on the smallest tables.

The full set runs at sf0.01 with ``python tools/oracle_check.py``; here a
representative subset per module keeps the suite quick.
"""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

from conftest import SF_SMALL

SUBSET = ["cache_lookup", "knn", "similarity_join", "threshold_sweep", "tune_models", "evaluate_pairs",
          "similarity_stats", "tuning_ranking", "report_best", "compare_models", "split_three_way_exact",
          "sample_n", "clean_pairs", "normalize_text", "embed_texts", "batch_prompts", "paraphrase_pairs",
          "compact", "threshold_what_if", "cache_stats"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "outcome" in df.columns
