"""The inverted-file index: centroids, lists and postings as Parquet tables.

An index folder holds versions; ``meta`` names the one that counts and is written last,
so a build that fails leaves the index before it as it was. Postings are partitioned by
a bucket of neighbouring lists and sorted by list inside its files, so a search prunes folders
by bucket and row groups by list, and 65,536 lists don't make as many folders.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layout import Layout
from . import kmeans
from .validate import VectorError, dimension

#: Most folders of postings, and rows for each file of a bucket.
MOST_BUCKETS, FILE_ROWS = 1024, 2_000_000


@dataclass
class Index:
    """Tables of an index. postings: list_bucket, list_id, vec_id, embedding."""

    dim: int
    nlist: int
    n: int
    lists_per_bucket: int
    centroids: DataFrame
    lists: DataFrame
    postings: DataFrame

    @cached_property
    def centroid_array(self) -> np.ndarray:
        """Centroids by list id, read once."""
        return kmeans.centroid_matrix(self.centroids)


def extents(counts: DataFrame, layout: Layout) -> DataFrame:
    """(list_id, count, list_pages, start_page): where each list's pages begin. One row for each list."""
    before = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    pages = counts.withColumn("list_pages", layout.list_pages(F.col("count")))
    return pages.withColumn("start_page", F.coalesce(F.sum("list_pages").over(before), F.lit(0)) + layout.lists_start)


#: Ids of a list are ranked in so many spans side by side.
SPANS = 64


def slots(assigned: DataFrame) -> DataFrame:
    """``assigned`` with the place of each vector in its list, by id.

    A list is ranked in spans of the ids, between quantiles of all ids, and each span moved on by what the spans before
    it hold; so a list that has a third of all vectors is many tasks' work.
    """
    marks = assigned.agg(F.percentile_approx("vec_id", [i / SPANS for i in range(1, SPANS)], 10_000)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(marks)))) if marks else F.array().cast("array<bigint>")
    spanned = assigned.withColumn("span", F.size(F.filter(bounds, lambda m: m < F.col("vec_id"))))
    counts = spanned.groupBy("list_id", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("list_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each list and span
    moved = counts.select("list_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("list_id", "span").orderBy("vec_id"))
    ranked = spanned.withColumn("r", rank).join(moved, ["list_id", "span"])
    return ranked.withColumn("slot", (F.col("base") + F.col("r") - 1).cast("long")).select(*assigned.columns, "slot")


def in_memory(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec: str = "embedding") -> Index:
    """An index that isn't written: its postings are assigned when they are read."""
    assigned = kmeans.assign(vectors, centroids, id_col, vec)
    postings = assigned.select(F.lit(0).alias("list_bucket"), "list_id", "vec_id", "embedding")
    counts = kmeans.list_counts(kmeans.assign(vectors, centroids, id_col, vec, keep_vector=False), len(centroids))
    lists = extents(counts, Layout(centroids.shape[1], len(centroids)))
    built = Index(centroids.shape[1], len(centroids), vectors.count(), len(centroids), kmeans.centroid_table(vectors.sparkSession, centroids), lists, postings)
    built.centroid_array = centroids
    return built


def build_index(vectors: DataFrame, path: str, nlist: int = 0, sample: int = 0, iters: int = 10, seed: int | None = 42, sampling: str = "even", trainer: str = "lloyd", id_col: str = "vec_id", vec: str = "embedding") -> Index:
    """Trains, assigns and writes an index; 0 lists or sample: chosen from the number of vectors."""
    dim = dimension(vectors, vec)
    n = vectors.count()
    nlist = nlist or kmeans.auto_lists(n)
    if trainer == "lloyd":
        centroids, _ = kmeans.train(vectors, nlist, sample, iters, seed, sampling, id_col, vec)
    elif trainer == "mllib":
        if nlist > n:
            raise VectorError(f"{n} vectors can't make {nlist} lists")
        taken = kmeans.stride_sample(vectors, sample or kmeans.auto_sample(nlist), sampling, n, id_col)
        centroids = kmeans.train_mllib(taken, nlist, iters, seed or 0, vec)
        nlist = len(centroids)
    else:
        raise VectorError(f"no such trainer: {trainer}")
    per = -(-nlist // MOST_BUCKETS)
    session = vectors.sparkSession
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    session.createDataFrame(kmeans.centroid_table(session, centroids).toArrow()).coalesce(1).write.parquet(f"{version}/centroids")
    assigned = kmeans.assign(vectors, centroids, id_col, vec).drop("dist").withColumn("list_bucket", F.floor(F.col("list_id") / per).cast("int"))
    # Postings are shuffled once, by folder and a hash of the id, so that a large list is written by several tasks;
    # they lie in the order of list and id, and their slots are ranked where they are asked for (``physical``).
    files = F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // FILE_ROWS)))
    order = assigned.repartition("list_bucket", files).sortWithinPartitions("list_bucket", "list_id", "vec_id")
    order.write.partitionBy("list_bucket").parquet(f"{version}/postings")
    counts = kmeans.list_counts(session.read.parquet(f"{version}/postings").select("list_id"), nlist)
    counts.coalesce(1).write.parquet(f"{version}/lists")
    meta = session.createDataFrame([(dim, nlist, n, per, version.rpartition("/")[2])], "dim int, nlist int, n long, lists_per_bucket int, version string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/meta")
    return load_index(session, path)


def load_index(spark: SparkSession, path: str) -> Index:
    """The index of a folder; raises where its tables don't fit its meta data."""
    path = path.rstrip("/")
    meta = spark.read.parquet(f"{path}/meta").first()
    version = f"{path}/{meta['version']}"
    lists = spark.read.parquet(f"{version}/lists")
    n, nlist = lists.agg(F.sum("count"), F.count(F.lit(1))).first()
    if (n, nlist) != (meta["n"], meta["nlist"]):
        raise VectorError(f"the index has {n} vectors in {nlist} lists, its meta data say {meta['n']} in {meta['nlist']}")
    postings = spark.read.parquet(f"{version}/postings")
    centroids = spark.read.parquet(f"{version}/centroids")
    return Index(meta["dim"], nlist, n, meta["lists_per_bucket"], centroids, extents(lists, Layout(meta["dim"], nlist)) if _fits(meta["dim"]) else lists, postings)


def _fits(dim: int) -> bool:
    try:
        Layout(dim, 1)
    except ValueError:
        return False
    return True


def physical(index: Index) -> DataFrame:
    """(list_id, slot, vec_id, page, offset) of every posting in the paged layout."""
    layout = Layout(index.dim, index.nlist)
    rows = slots(index.postings.select("list_id", "vec_id"))
    starts = index.lists.select("list_id", "start_page")
    placed = rows.select("list_id", "slot", "vec_id").join(starts, "list_id")
    return placed.select("list_id", "slot", "vec_id", layout.entry_page(F.col("start_page"), F.col("slot")).alias("page"), layout.entry_offset(F.col("slot")).alias("offset"))
