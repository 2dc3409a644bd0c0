"""Scale guard: no cartesian products anywhere; nested-loop joins only where
one side is provably tiny (a one-row aggregate, a threshold grid, a table
with one row per model, or the single-bucket rank offsets of tiny inputs)."""

import __spark_entry__ as E
from nearhit.plans import catalog

from conftest import SF_SMALL

BOUNDED_NLJ = {
    "cache_stats": "one-row aggregates",
    "knn_approx_recall": "one-row aggregates",
    "paraphrase_yield": "one-row aggregates",
    "seeded_simulation": "one-row aggregates",
    "threshold_summary": "one row per model",
    "threshold_what_if": "threshold grid x at most len(grid)+1 bucket counts",
    "k_folds_exact": "rank offsets: one bucket at this size",
    "sample_n": "rank offsets: one bucket at this size",
    "sample_size_stability": "rank offsets: one bucket at this size",
    "split_three_way_exact": "rank offsets: one bucket at this size",
}


def test_plans_have_no_unbounded_nested_loops(spark):
    bad = []
    E.queries()
    for name, fn in sorted(catalog.QUERIES.items()):
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan:
            bad.append((name, "CartesianProduct"))
        if "BroadcastNestedLoopJoin" in plan and name not in BOUNDED_NLJ:
            bad.append((name, "BroadcastNestedLoopJoin"))
    assert not bad, bad


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = E.queries()["delete_by_ids"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan or "ReadSchema: struct<vec_id:bigint" in plan
    plan = E.queries()["cache_lookup"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "NestedLoopJoin" not in plan
