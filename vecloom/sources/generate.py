"""Synthetic vectors and query workloads. Seeds hang on chunks of ids, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of one random stream.
CHUNK = 1024


def centers(dim: int, clusters: int, seed: int) -> np.ndarray:
    """Cluster centres on the unit sphere."""
    points = np.random.default_rng([seed, 0]).standard_normal((clusters, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def clustered(spark: SparkSession, n: int = 500_000, dim: int = 128, clusters: int = 1000, noise: float = 0.15, seed: int = 1234) -> DataFrame:
    """(vec_id, embedding): centres with Gaussian noise on every value."""
    if clusters < 1 or dim < 1 or n < 0:
        raise ValueError("there must be a cluster and a value")
    chunks = -(-n // CHUNK)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = centers(dim, clusters, seed)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, 1, c])
                size = min(CHUNK, n - c * CHUNK)
                values = (middle[rng.integers(0, clusters, size)] + noise * rng.standard_normal((size, dim))).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * dim + 1, dim, dtype=np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(c * CHUNK, c * CHUNK + size)), lists], ["vec_id", "embedding"])

    return spark.range(chunks).mapInArrow(make, "vec_id long, embedding array<float>")


def workload(vectors: DataFrame, queries: int = 200, noise: float = 0.05, seed: int = 7, n: int | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, vec_id, embedding): random rows of dense ids with Gaussian noise; a row may be drawn again."""
    n = vectors.count() if n is None else n
    if not n:
        raise ValueError("there are no vectors to draw from")
    drawn = np.random.default_rng([seed, 0]).integers(0, n, queries)
    table = vectors.sparkSession.createDataFrame(pa.table({"query_id": pa.array(np.arange(queries)), "row": pa.array(drawn)}))

    def shake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [(np.asarray(v, np.float32) + noise * np.random.default_rng([seed, 1, q]).standard_normal(len(v))).astype(np.float32) for q, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float32()))], ["query_id", "vec_id", "embedding"])

    rows = vectors.join(F.broadcast(table), F.col(id_col) == F.col("row")).select("query_id", F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<float>").alias("embedding"))
    return rows.mapInArrow(shake, "query_id long, vec_id long, embedding array<float>")
