"""Recall and the figures of a search benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: hits, total and recall, over all queries of the truth together (not a mean of each query's)."""
    hits = truth.select("query_id", "vec_id").join(results.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    one = hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(truth.agg(F.count(F.lit(1)).alias("total")))  # a row each
    return one.withColumn("recall", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0))


def fewest_probes(truth: DataFrame, assigned: DataFrame, probes: DataFrame, least: float) -> int:
    """Fewest probes whose recall of the truth is at least so much; probes has all lists of each query.

    A true neighbour is found if its list is probed, so recall is the share of them by their list's probe rank.
    """
    lists = truth.select("query_id", "vec_id").join(assigned.select("vec_id", "list_id"), "vec_id")
    ranks = lists.join(probes, ["query_id", "list_id"]).groupBy("probe_rank").agg(F.count(F.lit(1)).alias("n")).orderBy("probe_rank").collect()  # a row for each list
    total, found = sum(r["n"] for r in ranks), 0
    for r in ranks:
        found += r["n"]
        if found >= least * total:
            return r["probe_rank"]
    return 1


def lower_rank(values: Column, share: float) -> Column:
    """The value of an array at the rank floor(share * (n - 1)) in order, not interpolated; null where it is empty."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) * F.lit(share)).cast("int"))


def lower_rank_of(values: list[float], share: float) -> float:
    return sorted(values)[int(share * (len(values) - 1))]


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def disk_mib(pages: Column, page: int = 4096) -> Column:
    return pages * page / F.lit(1024.0 * 1024.0)
