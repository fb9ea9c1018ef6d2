"""Approximate search: the nearest lists of each query, then the nearest vectors in them.

The lists of the queries are found by the executors. Few queries (a checked size) go out with their
lists: postings are cut to the folders of those lists when the scan is planned, and each task compares its rows
of a list with just the queries that probe it. More queries stay where they are: probes and postings are
dealt by list and by a part of it, meet in one pass over both, and no task holds more than a part of a list. Either way
a task returns the k nearest it has for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, l2sq
from .exact import _FOUND, RESULT, ranked
from .index import Index
from .validate import count_parameter, dimension


#: Bytes of probes that are sent to all tasks at once, and postings of a list that one task holds otherwise.
SENT, PART_ROWS = 64 << 20, 100_000


def coarse_probe(index: Index, queries: DataFrame, nprobe: int, query_id: str = "query_id", vec: str = "embedding", keep: bool = False) -> DataFrame:
    """(query_id, probe_rank, list_id, cdist) of the nprobe nearest lists of each query, and with keep its vector q; no shuffle."""
    count_parameter("nprobe", nprobe)
    dimension(queries, vec, index.dim)
    most = min(nprobe, index.nlist)
    sent = queries.sparkSession.sparkContext.broadcast(index.centroid_array)
    names = ["query_id", "probe_rank", "list_id", "cdist", *["q"] * keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sent.value
        for batch in batches:
            q, at, d = kernels.nearest(kernels.matrix(batch.column(1), lists.shape[1]), lists, np.arange(len(lists), dtype=np.int32), most)
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            own = [batch.column(1).take(pa.array(q))] if keep else []
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[q]), pa.array(rank), pa.array(at), pa.array(d), *own], names)

    rows = queries.select(F.col(query_id).cast("long").alias("i"), F.col(vec).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "query_id long, probe_rank long, list_id int, cdist double" + ", q array<float>" * keep)


def _within(dim: int, k: int, names: np.ndarray, vectors: np.ndarray, query: np.ndarray, list_of: np.ndarray):
    """A task function over (list_id, vec_id, embedding): the k nearest rows of each query that probes their list. list_of ascends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            found = [held]
            list_id, vec_id = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = kernels.matrix(batch.column(2), dim)
            by = np.argsort(list_id, kind="stable")
            edges = np.flatnonzero(np.r_[True, list_id[by][1:] != list_id[by][:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                here = by[a:b]
                low, high = np.searchsorted(list_of, [list_id[here[0]], list_id[here[0]] + 1])
                mine = query[low:high]
                got = kernels.nearest(vectors[mine], x[here], vec_id[here], k)
                found.append((mine[got[0]], got[1], got[2]))
            held = kernels.best(*(np.concatenate(c) for c in zip(*found)), k)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(names[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "vec_id", "dist"])

    return run


def _sent_out(index: Index, probed: pa.Table, k: int) -> DataFrame:
    """Results of the probes (query_id, list_id, q) that fit a broadcast."""
    session = index.postings.sparkSession
    names = probed["query_id"].to_numpy()
    list_of = probed["list_id"].to_numpy()
    order = np.argsort(list_of, kind="stable")
    vectors = kernels.matrix(probed["q"].combine_chunks(), index.dim)
    sent, dim = session.sparkContext.broadcast((names, vectors, order, list_of[order])), index.dim
    own = np.unique(list_of)
    buckets = (own // index.lists_per_bucket).astype(np.int32)
    wanted = session.createDataFrame(pa.table({"list_bucket": pa.array(buckets), "list_id": pa.array(own.astype(np.int32))}))
    # The folders are known, and at most MOST_BUCKETS: the scan lists no others.
    folders = index.postings.filter(F.col("list_bucket").isin(np.unique(buckets).tolist()))
    rows = folders.join(F.broadcast(wanted), ["list_bucket", "list_id"], "left_semi").select("list_id", "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, order, list_of = sent.value
        yield from _within(dim, k, names, vectors, order, list_of)(batches)

    return rows.mapInArrow(run, _FOUND)


def _met(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """The same for any number of probes (query_id, list_id, q): one join by list and a part of its postings."""
    # A list's postings are dealt into parts of about PART_ROWS; its queries go to each of them.
    parts = index.lists.select("list_id", F.greatest(F.lit(1), F.ceil(F.col("count") / PART_ROWS)).cast("int").alias("parts"))
    rows = index.postings.join(F.broadcast(parts), "list_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    rows = rows.select("list_id", "part", F.col("vec_id").alias("id"), F.lit(False).alias("asks"), F.col("embedding").cast("array<float>").alias("v"))
    asked = probes.join(F.broadcast(parts), "list_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("list_id", "part", F.col("query_id").alias("id"), F.lit(True).alias("asks"), F.col("q").alias("v"))

    # In a partition sorted so, a part's postings come before its queries, which stream by.
    both, dim = rows.unionByName(asked).repartition("list_id", "part").sortWithinPartitions("list_id", "part", "asks"), index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            list_id, part, ids, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = kernels.matrix(batch.column(4), dim)
            new = (list_id[1:] != list_id[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])
            edges = np.flatnonzero(np.r_[True, new, True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (list_id[a], part[a]) != now:
                    now, kept = (list_id[a], part[a]), []
                if not asks[a]:
                    kept.append((x[a:b], ids[a:b]))
                elif kept:
                    if len(kept) > 1:
                        kept = [tuple(np.concatenate(c) for c in zip(*kept))]
                    q, v, d = kernels.nearest(x[a:b], kept[0][0], kept[0][1], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][q]), pa.array(v), pa.array(d)], ["query_id", "vec_id", "dist"])

    return both.mapInArrow(run, _FOUND)


def ivf_search(index: Index, queries: DataFrame, k: int, nprobe: int, query_id: str = "query_id", vec: str = "embedding", sent: int = SENT) -> DataFrame:
    """RESULT: the k nearest vectors of each query among those in its nprobe nearest lists. Query ids must differ."""
    count_parameter("k", k)
    count_parameter("nprobe", nprobe)
    if not k or not nprobe:
        dimension(queries, vec, index.dim)
        return queries.sparkSession.createDataFrame([], RESULT)
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vec).cast("array<float>").alias("q"))
    probes = coarse_probe(index, queries, nprobe, query_id, vec, keep=True).select("query_id", "list_id", "q")
    # One row more than may be sent tells whether all of them may; nothing larger comes to the driver.
    per = max(1, sent // (4 * max(index.dim, 1) + 20))
    few = asked.limit(per // min(nprobe, index.nlist) + 1).count() <= per // min(nprobe, index.nlist)
    if few:
        table = probes.toArrow()
        return ranked(_sent_out(index, table, k), k) if table.num_rows else queries.sparkSession.createDataFrame([], RESULT)
    return ranked(_met(index, probes, k), k)


def ivf_search_expression(index: Index, queries: DataFrame, k: int, nprobe: int, query_id: str = "query_id", vec: str = "embedding") -> DataFrame:
    """The same by expressions only, for few queries: probes joined to postings, distances projected, ranked."""
    count_parameter("k", k)
    count_parameter("nprobe", nprobe)
    pairs = queries.select(F.col(query_id).alias("query_id"), F.col(vec).alias("q")).crossJoin(F.broadcast(index.centroids))
    near = Window.partitionBy("query_id").orderBy("cdist", "list_id")
    probes = pairs.withColumn("cdist", l2sq("q", "centroid")).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= min(nprobe, index.nlist))
    probes = probes.withColumn("list_bucket", F.floor(F.col("list_id") / index.lists_per_bucket).cast("int")).select("query_id", "q", "list_bucket", "list_id")
    return ranked(index.postings.join(probes, ["list_bucket", "list_id"]).select("query_id", "vec_id", l2sq("q", "embedding").alias("dist")), k)


def candidates(index: Index, probes: DataFrame) -> DataFrame:
    """(query_id, candidates): how many vectors the probed lists of each query hold."""
    return probes.join(index.lists.select("list_id", "count"), "list_id").groupBy("query_id").agg(F.sum("count").alias("candidates"))
