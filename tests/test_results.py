"""Nested result files: round trip, files of other shapes, first success in array order."""

import json

from nearhit.sources import results as N

FLAT = ("model_key string, success boolean, error string, optimal_threshold double, tuning_samples long, valid_samples long, "
        "invalid_samples long, optimization_metric string, min_precision_constraint double, accuracy double, precision double, "
        "recall double, f1_score double, true_negatives long, false_positives long, false_negatives long, true_positives long, "
        "dup_mean double, dup_std double, dup_min double, dup_max double, nondup_mean double, nondup_std double, "
        "nondup_min double, nondup_max double")


def rows():
    good = lambda key, t: (key, True, None, t, 10, 9, 1, "f1", None, .9, .8, .7, .6, 1, 2, 3, 4, .5, .1, .2, .9, .3, .1, 0.0, .6)
    return [good("b", 0.75), ("a", False, 'no "pair"\n has a score', *[None] * 22), good("c", 0.5), ("d", None, None, *[None] * 22)]


def test_round_trip_and_file_shape(spark, tmp_path):
    path = str(tmp_path / "r")
    N.write_nested_results(spark.createDataFrame(rows(), FLAT).repartition(3), path)
    files = [f for f in (tmp_path / "r").iterdir() if f.name.startswith("part")]
    written = json.loads("".join(f.read_text() for f in files))
    assert [o["model_key"] for o in written] == ["a", "b", "c", "d"]
    assert set(written[0]) == {"model_key", "success", "error"} and set(written[3]) == {"model_key", "success"}
    assert written[1]["metrics_at_optimal"]["confusion_matrix"] == dict(zip(N.CELLS, (1, 2, 3, 4)))
    assert written[1]["similarity_stats"]["non_duplicates"] == {"mean": .3, "std": .1, "min": 0.0, "max": .6}
    flat = N.flat_results(N.read_nested_results(spark, path))
    names = [c.split()[0] for c in FLAT.split(", ")]
    got = sorted(tuple(r) for r in flat.select("place", *names).collect())
    want = sorted(rows(), key=lambda r: r[0])
    assert got == [(i, r[0], bool(r[1]), *r[2:]) for i, r in enumerate(want)]
    first = N.first_successful(flat).collect()
    assert len(first) == 1 and (first[0].place, first[0].model_key, first[0].optimal_threshold) == (1, "b", 0.75)


def test_other_files_missing_and_mistyped_fields(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "1.json").write_text('[{"model_key": "x", "optimal_threshold": "high", "extra": {"deep": [1]}}, 5, null,\n'
                                   ' {"model_key": 7, "success": true, "metrics_at_optimal": {"accuracy": 1}}]')
    (folder / "2.json").write_text('{"model_key": "object"}')
    (folder / "3.json").write_text('not json')
    (folder / "4.json").write_text('[]')
    flat = N.flat_results(N.read_nested_results(spark, str(folder)))
    got = sorted(tuple(r) for r in flat.select("place", "model_key", "success", "accuracy").collect())
    assert [g[0] for g in got] == [0, 1, 2, 3] and [g[2] for g in got] == [False, False, False, True]
    assert got[0][1] == "x" and got[3][1] == "7" and got[3][3] == 1.0
    assert flat.where("optimal_threshold IS NOT NULL").count() == 0
    assert N.first_successful(flat).first().model_key == "7"


def test_no_results(spark, tmp_path):
    path = str(tmp_path / "none")
    N.write_nested_results(spark.createDataFrame([], FLAT), path)
    flat = N.flat_results(N.read_nested_results(spark, path))
    assert flat.count() == 0 and N.first_successful(flat).count() == 0
