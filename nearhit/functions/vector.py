"""Column expressions over embedding arrays (JVM-side higher-order functions).

These are for row-wise work: one pair of vectors per row. All-pairs work
(kNN, similarity joins) goes through the block kernel in
``nearhit.operators.vector_join`` instead, which does matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Dot product in double precision (float32 inputs are widened first)."""
    a, b = _c(a), _c(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """Unit-length vector as array<double>; a zero vector gives null, never NaN."""
    a = _c(a)
    n = l2_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine_similarity(a, b) -> Column:
    """dot(a, b) / (|a| |b|); null when either vector has zero length."""
    a, b = _c(a), _c(b)
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den)


def similarity_to_distance(s, *, check: bool = True):
    """``1 - s``. A Python number is range-checked on the driver; a column is
    checked per row with ``raise_error`` (valid range 0..1)."""
    if isinstance(s, (int, float)):
        if not 0.0 <= float(s) <= 1.0:
            raise ValueError(f"similarity must lie in [0, 1], got {s}")
        return 1.0 - float(s)
    s = _c(s)
    if not check:
        return F.lit(1.0) - s
    return F.when((s < 0) | (s > 1),
                  F.raise_error(F.concat(F.lit("similarity out of [0,1]: "), s.cast("string")))
                  ).otherwise(F.lit(1.0) - s)


def check_dimension(a, expected: int) -> Column:
    """Return the vector, failing the task when its length is not ``expected``."""
    a = _c(a)
    return F.when(F.size(a) != expected,
                  F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {expected}, got "),
                                         F.size(a).cast("string")))).otherwise(a)


def dimension_mismatch(a, expected: int) -> Column:
    """Report variant of ``check_dimension``: true where the length differs."""
    return F.size(_c(a)) != F.lit(expected)


# --------------------------------------------------------------- vectorised path
#
# The higher-order-function forms above are interpreted per element, and
# Catalyst inlines a derived column into every expression that reads it (a
# 76-threshold sweep would evaluate the cosine 76 times). The Arrow UDF below
# flattens each batch's list columns into matrices and is evaluated exactly once per row.


def matrices(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, A, B) for each length that both lists of a row have; rows with a null, empty or unequal list are left out."""
    la, lb = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b))
    for n in np.unique(la[(la == lb) & (la > 0)]):
        rows = np.flatnonzero((la == n) & (lb == n))
        take = pa.array(rows)
        yield (rows, *(x.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n) for x in (a, b)))


def _rowwise_cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    out, valid = np.zeros(len(a)), np.zeros(len(a), dtype=bool)
    for rows, A, B in matrices(a, b):
        den = np.linalg.norm(A, axis=1) * np.linalg.norm(B, axis=1)
        ok = den > 0
        out[rows[ok]] = np.einsum("ij,ij->i", A, B)[ok] / den[ok]
        valid[rows[ok]] = True
    return pa.array(out, mask=~valid)


_UDFS: dict = {}


def cosine_similarity_batched(a, b) -> Column:
    """Row-wise cosine similarity through one numpy pass per Arrow batch;
    null for missing, zero or mismatched vectors."""
    if "cos" not in _UDFS:
        _UDFS["cos"] = F.arrow_udf(_rowwise_cosine, "double")
    return _UDFS["cos"](_c(a), _c(b))
