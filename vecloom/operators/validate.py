"""Checks of vectors and parameters where they enter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VectorError(ValueError):
    """Vectors or parameters that an operator can't work on."""


def dataset_stats(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: n, least_dim, most_dim, n_null (vector or value), n_nan (NaN or infinite)."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(v)).cast("long").alias("least_dim"),
        F.max(F.size(v)).cast("long").alias("most_dim"),
        F.count_if(v.isNull() | F.exists(v, lambda x: x.isNull())).alias("n_null"),
        F.count_if(bad).alias("n_nan"),
    )


def dimension(vectors: DataFrame, vec: str = "embedding", dim: int | None = None) -> int:
    """The length of all vectors, in one pass; raises where they differ or hold nulls or NaN."""
    s = dataset_stats(vectors, vec).first()
    if s["n_null"] or s["n_nan"]:
        raise VectorError(f"{s['n_null']} vectors are null or hold nulls, {s['n_nan']} hold NaN or infinite values")
    if s["n"] and s["least_dim"] != s["most_dim"]:
        raise VectorError(f"vectors have {s['least_dim']} to {s['most_dim']} values")
    found = s["least_dim"] if s["n"] else dim or 0
    if s["n"] and found == 0:
        raise VectorError("vectors have no values")
    if dim is not None and found != dim:
        raise VectorError(f"vectors have {found} values, {dim} are expected")
    return found


def count_parameter(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise VectorError(f"{name} must be 0 or more, not {value!r}")
    return value
