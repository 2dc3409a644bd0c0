"""SQL text pieces shared by the oracle twins (DuckDB dialect)."""

from __future__ import annotations


def ratio(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END)"


def metrics_sql(tp="true_positives", fp="false_positives", tn="true_negatives", fn="false_negatives",
                rules: str = "textbook", spec: bool = True) -> str:
    tot = f"({tp} + {fp} + {tn} + {fn})"
    acc = ratio(f"{tp} + {tn}", tot)
    prec = ratio(tp, f"{tp} + {fp}")
    rec = ratio(tp, f"{tp} + {fn}")
    f1 = ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    if rules == "tuner":
        neg, pos = f"({tp} + {fp}) = 0", f"({tp} + {fp}) = {tot}"
        prec = f"(CASE WHEN {neg} THEN 1.0 WHEN {pos} THEN 0.0 ELSE {prec} END)"
        rec = f"(CASE WHEN {neg} THEN 0.0 WHEN {pos} THEN 1.0 ELSE {rec} END)"
        f1 = f"(CASE WHEN {neg} OR {pos} THEN 0.0 ELSE {f1} END)"
    out = f"{acc} AS accuracy, {prec} AS precision, {rec} AS recall, {f1} AS f1_score"
    if spec:
        out += f", {ratio(tn, f'{tn} + {fp}')} AS specificity"
    return out


def tidy_sql(inner: str, doubles: list[str], bools: list[str] = (), ints: list[str] = ()) -> str:
    """Round double columns, cast booleans/ints to BIGINT, keep the rest."""
    rep = [f"(round(CAST({c} AS DOUBLE), 6) + 0.0) AS {c}" for c in doubles]
    rep += [f"CAST({c} AS BIGINT) AS {c}" for c in list(bools) + list(ints)]
    if not rep:
        return inner
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM (\n{inner}\n) AS _t"


def grid_sql(grid: list[float]) -> str:
    ints = [round(t * 100) for t in grid]
    if ints == list(range(ints[0], ints[-1] + 1)) and all(abs(i / 100.0 - t) == 0 for i, t in zip(ints, grid)):
        return f"SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range({ints[0]}, {ints[-1] + 1}) AS t(i)"
    vals = ", ".join(f"({t!r}::DOUBLE)" for t in grid)
    return f"SELECT * FROM (VALUES {vals}) AS g(threshold)"


def sweep_sql(src: str, by: list[str], rules: str = "tuner") -> str:
    """Brute-force sweep: every (group, threshold) counted directly."""
    b = ", ".join(f"p.{c}" for c in by)
    return f"""SELECT *, {metrics_sql(rules=rules)} FROM (
  SELECT {b}, g.threshold,
    count(*) FILTER (WHERE p.similarity >= g.threshold AND p.is_duplicate = 1) AS true_positives,
    count(*) FILTER (WHERE p.similarity >= g.threshold AND p.is_duplicate = 0) AS false_positives,
    count(*) FILTER (WHERE p.similarity < g.threshold AND p.is_duplicate = 0) AS true_negatives,
    count(*) FILTER (WHERE p.similarity < g.threshold AND p.is_duplicate = 1) AS false_negatives,
    count(*) FILTER (WHERE p.is_duplicate IN (0, 1)) AS total
  FROM {src} p CROSS JOIN grid g
  WHERE p.similarity IS NOT NULL AND NOT isnan(p.similarity)
  GROUP BY {b}, g.threshold) AS _s"""


METRIC_COL = {"f1": "f1_score", "accuracy": "accuracy", "precision": "precision", "recall": "recall"}


def best_sql(sweep: str, by: list[str], metric: str = "f1", min_precision: float | None = None) -> str:
    where = "" if min_precision is None else f"WHERE precision >= {float(min_precision)!r}"
    part = ", ".join(by)
    return f"""SELECT * EXCLUDE (_rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {METRIC_COL[metric]} DESC, threshold ASC) AS _rn
  FROM {sweep} {where}) AS _b WHERE _rn = 1"""
