"""k-means for the coarse lists: a bounded sample, Lloyd iterations, a deterministic start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, l2sq
from .validate import VectorError, count_parameter, dimension

#: Bounds of the automatic number of lists, and of the sample: at least so many, or so many for each list.
FEWEST_LISTS, MOST_LISTS = 16, 65536
SAMPLE, SAMPLE_PER_LIST = 50_000, 48


def auto_lists(n: int) -> int:
    import math

    return max(FEWEST_LISTS, min(MOST_LISTS, math.isqrt(n)))


def auto_sample(nlist: int) -> int:
    return max(SAMPLE, SAMPLE_PER_LIST * nlist)


def stride_of(n: int, cap: int, sampling: str = "even") -> int:
    """Step between sampled ids. ``even`` spans all ids; ``stride`` rounds down, and so keeps only the first ids where n is below twice the cap."""
    if sampling not in ("even", "stride"):
        raise VectorError(f"no such sampling: {sampling}")
    least = max(1, min(n, cap))
    return max(1, n // least if sampling == "stride" else -(-n // least))


def stride_sample(vectors: DataFrame, cap: int, sampling: str = "even", n: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """Vectors at every step of the ids in order, the lowest ``cap`` of them.

    Where ids are dense (0 to n - 1) that is a filter, which reaches the scan; whether they are, their least, greatest and distinct
    count say. Other ids are hashed, and of those whose hash lies in a share of its range the first ``cap`` are
    taken: an even sample too, whatever the ids look like.
    """
    count_parameter("cap", cap)
    n = vectors.count() if n is None else n
    step = stride_of(n, cap, sampling)
    low, high, kinds = vectors.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    if not n or (low, high, kinds) == (0, n - 1, n):
        return vectors.filter((F.col(id_col) % step == 0) & (F.col(id_col) < step * cap))
    # Twice the share that is asked for holds cap rows almost surely; where it doesn't, all rows are ordered.
    place = F.xxhash64(F.col(id_col), F.lit(0x5EED))
    share = min(1.0, 2.0 * cap / n + 100.0 / n)
    near = vectors.filter(place < F.lit(int(-(2**63) + min(share * 2.0**64, 2.0**64 - 2**12))).cast("long")) if share < 1 else vectors
    if share < 1 and near.count() < min(cap, n):
        near = vectors
    return near.orderBy(place, id_col).limit(cap)


def seed_centroids(sample: DataFrame, nlist: int, seed: int | None = 42, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(list_id, vec_id, centroid): the first nlist sampled vectors by a hash of id and seed; without a seed by id."""
    order = [F.xxhash64(id_col, F.lit(seed)), F.col(id_col)] if seed is not None else [F.col(id_col)]
    chosen = sample.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("centroid"), *(o.alias(f"o{i}") for i, o in enumerate(order)))
    keys = [f"o{i}" for i in range(len(order))]
    first = chosen.orderBy(*keys).limit(nlist)
    return first.withColumn("list_id", F.row_number().over(Window.orderBy(*keys)) - 1).select("list_id", "vec_id", "centroid")  # nlist rows


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    rows = pa.table({"list_id": pa.array(np.arange(len(centroids), dtype=np.int32)), "centroid": pa.array(list(centroids.astype(np.float32)), pa.list_(pa.float32()))})
    return spark.createDataFrame(rows)


def centroid_matrix(centroids: DataFrame) -> np.ndarray:
    """Centroids by list id on the driver; at most MOST_LISTS rows."""
    rows = centroids.select("list_id", "centroid").limit(MOST_LISTS + 1).toArrow().sort_by("list_id")
    if rows.num_rows > MOST_LISTS:
        raise VectorError(f"there are more than {MOST_LISTS} lists")
    if rows.num_rows and rows["list_id"].to_pylist() != list(range(rows.num_rows)):
        raise VectorError("list ids must run from 0")
    return kernels.matrix(rows["centroid"].combine_chunks()) if rows.num_rows else np.zeros((0, 0), np.float32)


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec: str = "embedding", keep_vector: bool = True) -> DataFrame:
    """(vec_id, list_id, dist, embedding): the nearest centroid of each vector, ties to the lower list. No shuffle."""
    if not len(centroids):
        raise VectorError("there are no lists")
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    names = ["vec_id", "list_id", "dist", *["embedding"] * keep_vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sent.value
        for batch in batches:
            x = kernels.matrix(batch.column(1), lists.shape[1])
            _, at, d = kernels.nearest(x, lists, np.arange(len(lists), dtype=np.int32), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(d), *[batch.column(1)] * keep_vector], names)

    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, list_id int, dist double" + ", embedding array<float>" * keep_vector)


def assign_expression(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The same by expressions: a broadcast of the centroids (at most MOST_LISTS) and a minimum of structs."""
    pairs = vectors.crossJoin(F.broadcast(centroids.select("list_id", "centroid").limit(MOST_LISTS)))
    least = F.min(F.struct(l2sq(vec, "centroid").alias("dist"), "list_id"))
    return pairs.groupBy(F.col(id_col).alias("vec_id")).agg(least.alias("m")).select("vec_id", "m.list_id", "m.dist")


def list_counts(assigned: DataFrame, nlist: int) -> DataFrame:
    """(list_id, count) of every list, empty ones too."""
    every = assigned.sparkSession.range(nlist).select(F.col("id").cast("int").alias("list_id"))
    counts = assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def sums(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(list_id, n, sse, total): how many vectors each list has, their squared distances and their sum by value.

    Each task adds up its own vectors, so a row for each list and task is shuffled.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sent.value
        n, sse, total = np.zeros(len(lists), np.int64), np.zeros(len(lists)), np.zeros((len(lists), dim))
        for batch in batches:
            x = kernels.matrix(batch.column(0), dim)
            _, at, d = kernels.nearest(x, lists, np.arange(len(lists), dtype=np.int32), 1)
            n += np.bincount(at, minlength=len(lists))
            sse += np.bincount(at, d, minlength=len(lists))
            np.add.at(total, at, x.astype(np.float64))
        own = np.flatnonzero(n)
        if own.size:
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(sse[own]), pa.array(list(total[own]), pa.list_(pa.float64()))], ["list_id", "n", "sse", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [*batches]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        own, at = np.unique(t["list_id"].to_numpy(), return_inverse=True)
        total = np.zeros((len(own), dim))
        np.add.at(total, at, t["total"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        n, sse = np.zeros(len(own), np.int64), np.bincount(at, t["sse"].to_numpy())
        np.add.at(n, at, t["n"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(sse), pa.array(list(total), pa.list_(pa.float64()))], t.schema.names)

    schema = "list_id int, n long, sse double, total array<double>"
    return vectors.select(F.col(vec).cast("array<float>").alias("v")).mapInArrow(run, schema).repartition("list_id").mapInArrow(add, schema)


def train(vectors: DataFrame, nlist: int, sample_cap: int = 0, iters: int = 10, seed: int | None = 42, sampling: str = "even", id_col: str = "vec_id", vec: str = "embedding") -> tuple[np.ndarray, list[float]]:
    """Centroids (nlist, dim) and the mean squared distance before each update.

    Just ``iters`` iterations; a list without vectors is put on a sampled vector that a
    hash of seed, iteration and list chooses. Without a seed lists start from the first sampled ids.
    """
    count_parameter("nlist", nlist)
    dimension(vectors, vec)
    n = vectors.count()
    cap = sample_cap or auto_sample(nlist)
    if not 0 < nlist <= n:
        raise VectorError(f"{n} vectors can't make {nlist} lists")
    sample = stride_sample(vectors, cap, sampling, n, id_col).select(F.col(id_col).alias("vec_id"), F.col(vec).alias("embedding")).persist()
    try:
        size = sample.count()
        if size < nlist:
            raise VectorError(f"a sample of {size} vectors can't make {nlist} lists")
        centroids = centroid_matrix(seed_centroids(sample, nlist, seed))
        log = []
        for i in range(iters):
            added = sums(sample, centroids).toArrow()
            found = added["list_id"].to_numpy()
            log.append(float(added["sse"].to_numpy().sum() / size))
            new = centroids.copy()
            total = added["total"].combine_chunks().flatten().to_numpy().reshape(len(found), -1)
            new[found] = (total / added["n"].to_numpy()[:, None]).astype(np.float32)
            empty = np.setdiff1d(np.arange(nlist), found)
            if empty.size:
                again = centroid_matrix(seed_centroids(sample, min(size, empty.size), (seed or 0) * 1_000_003 + i + 1))
                new[empty] = again[np.arange(empty.size) % len(again)]
            centroids = new
        return centroids, log
    finally:
        sample.unpersist()


def train_mllib(vectors: DataFrame, nlist: int, iters: int = 10, seed: int = 42, vec: str = "embedding") -> np.ndarray:
    """Centroids by MLlib's k-means, which may find fewer and stops once they rest."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=nlist, initMode="random", maxIter=iters, tol=0.0, seed=seed).fit(vectors.select(array_to_vector(vec).alias("features")))
    return np.array(model.clusterCenters(), np.float32)
