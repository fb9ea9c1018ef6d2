"""Exact nearest neighbours: one pass over the vectors for a block of queries.

Each task keeps the k nearest of its own rows for each query and returns only those, so
what is shuffled doesn't grow with the vectors but with tasks, queries and k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, l2sq
from .blocks import in_blocks
from .validate import count_parameter, dimension

RESULT = "query_id long, rank long, vec_id long, dist double"
_FOUND = "query_id long, vec_id long, dist double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, dist) of the k nearest; ties to smaller ids."""
    by = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


def exact_one(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(rank, vec_id, dist) of one query vector, by expressions only: a top-k of projected distances."""
    count_parameter("k", k)
    dimension(vectors, vec, len(query))
    point = F.array(*(F.lit(float(x)).cast("float") for x in query))
    top = vectors.select(F.col(id_col).alias("vec_id"), l2sq(vec, point).alias("dist")).orderBy("dist", "vec_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("dist", "vec_id")).cast("long")).select("rank", "vec_id", "dist")  # k rows


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """RESULT: the k nearest vectors of each query; exclude_self leaves out those of its own id."""
    count_parameter("k", k)
    dim = dimension(vectors, vec)
    session = vectors.sparkSession
    empty = session.createDataFrame([], RESULT)
    if not k or not dim:
        return empty
    dimension(queries, vec, dim)
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec).alias("v"))

    def work(ids: np.ndarray, points: np.ndarray) -> DataFrame:
        sent = session.sparkContext.broadcast((ids, points))
        want = k + exclude_self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, own_points = sent.value
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                got = kernels.nearest(own_points, kernels.matrix(batch.column(1), dim), batch.column(0).to_numpy(), want)
                held = kernels.best(*(np.concatenate(c) for c in zip(held, got)), want)
            q, v, d = held
            if exclude_self:
                q, v, d = (c[own[q] != v] for c in held)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(v), pa.array(d)], ["query_id", "vec_id", "dist"])

        return rows.mapInArrow(run, _FOUND)

    found = in_blocks(queries, dim, work, query_id, vec)
    return empty if found is None else ranked(found, k)


def pairwise(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, vec_id, dist) of every query with every vector, in blocks of queries."""
    dim = dimension(vectors, vec)
    dimension(queries, vec, dim)
    session = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec).alias("v"))

    def work(ids: np.ndarray, points: np.ndarray) -> DataFrame:
        sent = session.sparkContext.broadcast((ids, points))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, own = kernels.matrix(batch.column(1), dim), batch.column(0).to_numpy()
                for i, point in zip(*sent.value):
                    d = kernels.exact(np.broadcast_to(point, x.shape), x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own), pa.array(d)], ["query_id", "vec_id", "dist"])

        return rows.mapInArrow(run, _FOUND)

    found = in_blocks(queries, dim, work, query_id, vec)
    return session.createDataFrame([], _FOUND) if found is None else found


def point_lookup(vectors: DataFrame, row: int, id_col: str = "vec_id") -> DataFrame:
    """The one vector of an id, by a filter that reaches the scan; raises unless there is just one."""
    found = vectors.filter(F.col(id_col) == row)
    n = found.limit(2).count()
    if n != 1:
        raise IndexError(f"{'no vector has' if not n else 'several vectors have'} id {row}")
    return found
