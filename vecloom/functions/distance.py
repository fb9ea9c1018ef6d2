"""Squared Euclidean distance and norms as Catalyst expressions.

Values are floats, sums are doubles accumulated from left to right. Vectors of different
length give null, so inputs are validated where they enter (``operators.validate``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

L2SQ = "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v)"

#: The same for DuckDB, over {a} and {b}; bit for bit equal.
DUCKDB_L2SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two vectors."""

    def squared(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, squared), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column | str) -> Column:
    """The vector at length 1, as floats; a vector of zeros stays as it is."""
    # The one-element array keeps the norm from being computed again for each value.
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")).cast("float")))
    return F.get(scaled, F.lit(0))


def register(spark: SparkSession, name: str = "l2sq") -> None:
    """Makes the distance a SQL function of the session, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {L2SQ}")
