"""The queries of the vector-search operators, over ``embeddings``, and their SQL for DuckDB.

Searches take every vector whose id is divisible by 50 as a query, against all vectors.
Lists start from the first vectors by id at an even step, a rule that SQL can follow; a
production index trains them (``operators.index``). Distances are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import DUCKDB_L2SQ, Layout, norm, normalized
from ..operators import cache, exact, index, kmeans, metrics, search, validate
from ..session import shared_folder
from ..sources import generate, rawvec

K, NPROBE, EVERY = 10, 8, 50
PROBES = (1, 2, 4, 8, 16)
#: Rounds of the training that SQL follows.
ITERS = 3
#: Recall that the trained search is tuned for, on at most so many vectors; a little above 0.9, as it is measured on others than are searched.
LEAST_RECALL, TUNED = 0.93, 1000
#: Milliseconds for the latency report; a fixed list.
LATENCIES = [5.5, 4.25, 9.75, 6.0, 4.5, 30.25, 5.0, 4.75, 7.5, 6.25, 5.25, 8.0, 4.0, 12.5, 5.75, 6.5, 7.0, 6.75, 4.125, 5.125]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def query_set(v: DataFrame) -> DataFrame:
    return v.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def rounded(column: str) -> Column:
    return F.round(column, 6).alias(column)


def start_lists(v: DataFrame) -> tuple[DataFrame, int]:
    """(list_id, vec_id, centroid) and how many, by the stride rule."""
    n = v.count()
    nlist = kmeans.auto_lists(n)
    return kmeans.seed_centroids(kmeans.stride_sample(v, nlist, "stride", n), nlist, None), nlist


def start_index(v: DataFrame) -> index.Index:
    return index.in_memory(v, kmeans.centroid_matrix(start_lists(v)[0]))


def exact_topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    query = exact.point_lookup(v, 0).first()["embedding"]
    return exact.exact_one(v, query, K).select("rank", "vec_id", rounded("dist"))


def exact_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return exact.exact_search(v, query_set(v), K).select("query_id", "rank", "vec_id", rounded("dist"))


def knn_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return exact.exact_search(v, query_set(v), K, exclude_self=True).select("query_id", "rank", "vec_id", rounded("dist"))


def pairwise_l2sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return exact.pairwise(v, query_set(v)).select("query_id", "vec_id", rounded("dist"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.point_lookup(vectors(spark, sf_dir), 7)
    return found.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select("vec_id", F.col("pos").cast("long"), F.col("value").cast("double"))


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    n = v.count()
    return kmeans.stride_sample(v, 4 * kmeans.auto_lists(n), "stride", n).select("vec_id")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.round(norm("embedding"), 6).alias("norm"))


def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = vectors(spark, sf_dir).select("vec_id", F.posexplode(normalized("embedding")).alias("pos", "value"))
    return each.select("vec_id", F.col("pos").cast("long"), F.round(F.col("value").cast("double"), 6).alias("value"))


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dataset_stats(vectors(spark, sf_dir))


def dim_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def seed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return start_lists(vectors(spark, sf_dir))[0].select(F.col("list_id").cast("long"), "vec_id")


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    assigned = kmeans.assign(v, kmeans.centroid_matrix(start_lists(v)[0]), keep_vector=False)
    return assigned.select("vec_id", F.col("list_id").cast("long"), rounded("dist"))


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return start_index(vectors(spark, sf_dir)).lists.select(F.col("list_id").cast("long"), "count")


def kmeans_update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    added = kmeans.sums(v, kmeans.centroid_matrix(start_lists(v)[0]))
    means = added.select(F.col("list_id").cast("long"), F.posexplode("total").alias("pos", "x"), "n")
    return means.select("list_id", F.col("pos").cast("long"), F.round(F.col("x") / F.col("n"), 6).alias("value"))


def kmeans_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    added = kmeans.sums(v, kmeans.centroid_matrix(start_lists(v)[0]))
    return added.agg(F.sum("n").alias("n"), F.round(F.sum("sse") / F.sum("n"), 6).alias("mse"))


def layout_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = start_index(vectors(spark, sf_dir)).lists
    return lists.select(F.col("list_id").cast("long"), "count", "list_pages", "start_page")


def posting_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.physical(start_index(vectors(spark, sf_dir))).withColumn("list_id", F.col("list_id").cast("long"))


def coarse_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    probes = search.coarse_probe(start_index(v), query_set(v), NPROBE)
    return probes.select("query_id", "probe_rank", F.col("list_id").cast("long"), rounded("cdist"))


def ivf_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return search.ivf_search(start_index(v), query_set(v), K, NPROBE).select("query_id", "rank", "vec_id", rounded("dist"))


def ivf_search_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return search.ivf_search_expression(start_index(v), query_set(v), K, NPROBE).select("query_id", "rank", "vec_id", rounded("dist"))


def ivf_full_probe_equals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact results a search of all lists finds: all of them."""
    v = vectors(spark, sf_dir)
    built = start_index(v)
    return metrics.recall(search.ivf_search(built, query_set(v), K, built.nlist), exact.exact_search(v, query_set(v), K))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    out = metrics.recall(search.ivf_search(start_index(v), query_set(v), K, NPROBE), exact.exact_search(v, query_set(v), K))
    return out.select("hits", "total", rounded("recall"))


def recall_by_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    built, truth = start_index(v), exact.exact_search(v, query_set(v), K)
    parts = [metrics.recall(search.ivf_search(built, query_set(v), K, p), truth).select(F.lit(p).cast("long").alias("nprobe"), "hits", "total", rounded("recall")) for p in PROBES]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scan_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    built = start_index(v)
    found = search.candidates(built, search.coarse_probe(built, query_set(v), NPROBE))
    return found.select("query_id", "candidates", F.round(F.col("candidates") / built.n, 6).alias("fraction"))


def page_access_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    built = start_index(v)
    return cache.page_trace(built, search.coarse_probe(built, query_set(v), NPROBE))


def trace_disk_mib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and MiB that each query touches."""
    trace = page_access_trace(spark, sf_dir)
    return trace.groupBy("query_id").agg(F.count(F.lit(1)).alias("pages")).select("query_id", "pages", F.round(metrics.disk_mib(F.col("pages")), 6).alias("mib"))


def latency_p95_lower_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([(x,) for x in LATENCIES], "ms double")
    return table.agg(F.round(F.avg("ms"), 6).alias("mean_ms"), metrics.lower_rank(F.collect_list("ms"), 0.95).alias("p95_ms"))


def cache_policy_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.simulate(page_access_trace(spark, sf_dir), frames=[16, 64, 256])


def open_page_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.open_trace(start_index(vectors(spark, sf_dir)))


def scatter_page_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.scatter_trace(start_index(vectors(spark, sf_dir))).select("seq", "page")


def scatter_policy_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.simulate(cache.scatter_trace(start_index(vectors(spark, sf_dir))), frames=[8, 64])


def cache_lru_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lru_hits(page_access_trace(spark, sf_dir), 64)


def datagen_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.clustered(spark, 6000, 24, 32, 0.1, 5)


def query_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.workload(vectors(spark, sf_dir), 200, 0.05, 7)


def mllib_ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    lists = kmeans.train_mllib(v, kmeans.auto_lists(v.count()))
    return search.ivf_search(index.in_memory(v, lists), query_set(v), K, NPROBE)


def trained_index(v: DataFrame) -> index.Index:
    """Lists trained on the documented sample, as a production index has them."""
    return index.in_memory(v, kmeans.train(v, kmeans.auto_lists(v.count()))[0])


def tuned_probes(v: DataFrame, built: index.Index) -> int:
    """Fewest probes for LEAST_RECALL, measured on at most TUNED vectors that aren't queries."""
    others = v.filter(F.col("vec_id") % EVERY == EVERY // 2).orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNED)
    held_out = others.select(F.col("vec_id").alias("query_id"), "embedding")
    truth = exact.exact_search(v, held_out, K).select("query_id", "vec_id")
    return metrics.fewest_probes(truth, kmeans.assign(v, built.centroid_array, keep_vector=False), search.coarse_probe(built, held_out, built.nlist), LEAST_RECALL)


def ivf_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    built = trained_index(v)
    return search.ivf_search(built, query_set(v), K, tuned_probes(v, built)).select("query_id", "rank", "vec_id", rounded("dist"))


def recall_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of the trained search, of how many lists, and its recall."""
    v = vectors(spark, sf_dir)
    built = trained_index(v)
    probes = tuned_probes(v, built)
    out = metrics.recall(search.ivf_search(built, query_set(v), K, probes), exact.exact_search(v, query_set(v), K))
    return out.select(F.lit(probes).cast("long").alias("nprobe"), F.lit(built.nlist).cast("long").alias("nlist"), "hits", "total", rounded("recall"))


def trained_start(v: DataFrame) -> tuple[int, dict]:
    """Lists, and the parameters of a training that SQL can follow: all vectors, from the first ids, ITERS rounds."""
    n = v.count()
    return kmeans.auto_lists(n), {"iters": ITERS, "seed": None, "sampling": "stride"}


def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training: values of the centroids after ITERS rounds."""
    v = vectors(spark, sf_dir)
    nlist, how = trained_start(v)
    found = kmeans.centroid_table(spark, kmeans.train(v, nlist, max(nlist, v.count()), **how)[0])
    each = found.select(F.col("list_id").cast("long"), F.posexplode("centroid").alias("pos", "x"))
    return each.select("list_id", F.col("pos").cast("long"), F.round(F.col("x").cast("double"), 5).alias("value"))


def written_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index built into the shared folder and loaded again."""
    v, path = vectors(spark, sf_dir), shared_folder(spark, "index")
    nlist, how = trained_start(v)
    index.build_index(v, path, nlist, max(nlist, v.count()), **how)
    return index.load_index(spark, path)


def build_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every vector of a written index lies: its list, slot, page and offset."""
    return index.physical(written_index(spark, sf_dir)).withColumn("list_id", F.col("list_id").cast("long"))


def ivf_search_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ivf_search(written_index(spark, sf_dir), query_set(vectors(spark, sf_dir)), K, NPROBE).select("query_id", "rank", "vec_id", rounded("dist"))


def ivf_search_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by the way for more queries than may be sent to all tasks."""
    return search.ivf_search(written_index(spark, sf_dir), query_set(vectors(spark, sf_dir)), K, NPROBE, sent=1).select("query_id", "rank", "vec_id", rounded("dist"))


def rawvec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as flat files and read again."""
    path = shared_folder(spark, "rawvec").removeprefix("file:").replace("//", "/")
    rawvec.write_rawvec(vectors(spark, sf_dir), path, partitions=3)
    each = rawvec.read_rawvec(spark, path).select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return each.select("vec_id", F.col("pos").cast("long"), F.col("value").cast("double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exact_topk_single, exact_topk_batch, knn_self_join, pairwise_l2sq, point_lookup, stride_sample, vector_norms, normalize_vectors, dataset_stats,
        dim_histogram, seed_centroids, assign_nearest, list_counts, kmeans_update_step, kmeans_mse, layout_extents, posting_slots, coarse_probe,
        ivf_search_batch, ivf_search_expression, ivf_full_probe_equals_exact, recall_at_k, recall_by_nprobe, scan_fraction, page_access_trace,
        trace_disk_mib, latency_p95_lower_rank, cache_policy_sim, open_page_trace, scatter_page_trace, scatter_policy_sim, cache_lru_exact, datagen_clustered, query_workload, mllib_ivf_search,
        ivf_search_trained, recall_trained, kmeans_train, build_index_roundtrip, ivf_search_written, ivf_search_joined, rawvec_roundtrip,
    )
}

_L = Layout(64, 1)
_E = "SELECT vec_id, embedding AS v FROM embeddings"
_D = DUCKDB_L2SQ.format
#: Shared parts: queries, lists, assignment, extents, probes, exact and approximate results.
_WITH = f"""
WITH RECURSIVE e AS ({_E}), n AS (SELECT count(*)::BIGINT AS n, greatest({kmeans.FEWEST_LISTS}, least({kmeans.MOST_LISTS}, floor(sqrt(count(*)))::BIGINT)) AS nlist FROM e),
q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % {EVERY} = 0),
c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS list_id, vec_id, v AS c FROM e, n
    WHERE vec_id % greatest(1, n // least(n, nlist)) = 0 QUALIFY row_number() OVER (ORDER BY vec_id) <= nlist),
a AS (SELECT e.vec_id, c.list_id, {_D(a="v", b="c")} AS dist, v FROM e, c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY dist, list_id) = 1),
l AS (SELECT c.list_id, count(a.vec_id)::BIGINT AS count FROM c LEFT JOIN a ON a.list_id = c.list_id GROUP BY c.list_id),
g AS (SELECT list_id, count, ((count + {_L.entries_per_page - 1}) // {_L.entries_per_page})::BIGINT AS list_pages FROM l),
x AS (SELECT list_id, count, list_pages, (coalesce(sum(list_pages) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
    + (nlist + {_L.centroids_per_page - 1}) // {_L.centroids_per_page} + (nlist + {_L.extents_per_page - 1}) // {_L.extents_per_page})::BIGINT AS start_page FROM g, n),
p AS (SELECT query_id, list_id, {_D(a="q", b="c")} AS cdist, row_number() OVER (PARTITION BY query_id ORDER BY cdist, list_id) AS probe_rank FROM q, c),
f AS (SELECT query_id, vec_id, {_D(a="q", b="v")} AS dist FROM q, e),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM f QUALIFY rank <= {K}),
s AS (SELECT p.query_id, a.vec_id, p.probe_rank, f.dist FROM p JOIN a ON a.list_id = p.list_id JOIN f ON f.query_id = p.query_id AND f.vec_id = a.vec_id),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s WHERE probe_rank <= {NPROBE} QUALIFY rank <= {K}),
runs AS (SELECT query_id, 0::BIGINT AS part, 1::BIGINT AS start, ((nlist + {_L.centroids_per_page - 1}) // {_L.centroids_per_page})::BIGINT AS pages FROM q, n
    UNION ALL SELECT query_id, probe_rank, start_page, list_pages FROM p JOIN x USING (list_id) WHERE probe_rank <= {NPROBE}),
trace AS (SELECT (row_number() OVER (ORDER BY query_id, part, j) - 1)::BIGINT AS seq, query_id, (start + j)::BIGINT AS page, (pages - j - 1)::BIGINT AS readahead
    FROM (SELECT *, unnest(range(pages)) AS j FROM runs WHERE pages > 0))
"""
#: The training: centroids k0, k1, ...; then the last one's assignment, extents and probes.
_TRAIN = "k0 AS (SELECT vec_id AS list_id, v AS c FROM e, n WHERE vec_id < nlist)" + "".join(
    f""",
b{i} AS (SELECT e.vec_id, k.list_id, {_D(a="v", b="c")} AS dist, v FROM e, k{i} k QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY dist, list_id) = 1),
u{i} AS (SELECT list_id, pos, (sum(x) / count(*))::FLOAT AS x FROM (SELECT list_id, unnest(range(len(v)))::BIGINT AS pos, unnest(v)::DOUBLE AS x FROM b{i}) GROUP BY 1, 2),
k{i + 1} AS (SELECT list_id, list(x ORDER BY pos) AS c FROM u{i} GROUP BY 1)"""
    for i in range(ITERS)
)
_BUILT = f"""{_TRAIN},
ka AS (SELECT e.vec_id, k.list_id, {_D(a="v", b="c")} AS dist, v FROM e, k{ITERS} k QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY dist, list_id) = 1),
kl AS (SELECT k.list_id, count(ka.vec_id)::BIGINT AS count FROM k{ITERS} k LEFT JOIN ka ON ka.list_id = k.list_id GROUP BY k.list_id),
kg AS (SELECT list_id, count, ((count + {_L.entries_per_page - 1}) // {_L.entries_per_page})::BIGINT AS list_pages FROM kl),
kx AS (SELECT list_id, (coalesce(sum(list_pages) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
    + (nlist + {_L.centroids_per_page - 1}) // {_L.centroids_per_page} + (nlist + {_L.extents_per_page - 1}) // {_L.extents_per_page})::BIGINT AS start_page FROM kg, n),
ko AS (SELECT list_id, vec_id, row_number() OVER (PARTITION BY list_id ORDER BY vec_id) - 1 AS slot FROM ka),
kp AS (SELECT query_id, list_id, {_D(a="q", b="c")} AS cdist FROM q, k{ITERS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cdist, list_id) <= {NPROBE}),
ki AS (SELECT kp.query_id, ka.vec_id, {_D(a="q.q", b="ka.v")} AS away, row_number() OVER (PARTITION BY kp.query_id ORDER BY away, ka.vec_id) AS rank
    FROM kp JOIN ka ON ka.list_id = kp.list_id JOIN q ON q.query_id = kp.query_id QUALIFY rank <= {K})"""
_RECALL = "SELECT (SELECT count(*) FROM t SEMI JOIN {found} r ON t.query_id = r.query_id AND t.vec_id = r.vec_id)::BIGINT AS hits, (SELECT count(*) FROM t)::BIGINT AS total"

ORACLE_SQL: dict[str, str] = {
    "exact_topk_single": f"{_WITH}, one AS (SELECT e.vec_id, {_D(a='z.v', b='e.v')} AS dist FROM e, e z WHERE z.vec_id = 0) SELECT row_number() OVER (ORDER BY dist, vec_id) AS rank, vec_id, round(dist, 6) AS dist FROM one QUALIFY rank <= {K}",
    "exact_topk_batch": f"{_WITH} SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t",
    "knn_self_join": f"{_WITH} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank, vec_id, round(dist, 6) AS dist FROM f WHERE query_id <> vec_id QUALIFY rank <= {K}",
    "pairwise_l2sq": f"{_WITH} SELECT query_id, vec_id, round(dist, 6) AS dist FROM f",
    "point_lookup": "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings WHERE vec_id = 7",
    "stride_sample": f"{_WITH} SELECT vec_id FROM e, n WHERE vec_id % greatest(1, n // least(n, 4 * nlist)) = 0 QUALIFY row_number() OVER (ORDER BY vec_id) <= 4 * nlist",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
    "normalize_vectors": "WITH m AS (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), u AS (SELECT vec_id, n, unnest(range(len(v)))::BIGINT AS pos, unnest(v)::DOUBLE AS x FROM m) SELECT vec_id, pos, round((CASE WHEN n > 0 THEN x / n ELSE x END)::FLOAT::DOUBLE, 6) AS value FROM u",
    "dataset_stats": "SELECT count(*)::BIGINT AS n, min(len(embedding))::BIGINT AS least_dim, max(len(embedding))::BIGINT AS most_dim, count(*) FILTER (embedding IS NULL OR list_count(embedding) < len(embedding))::BIGINT AS n_null, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x))))::BIGINT AS n_nan FROM embeddings",
    "dim_histogram": "SELECT len(embedding)::BIGINT AS dim, count(*)::BIGINT AS n FROM embeddings GROUP BY 1",
    "seed_centroids": f"{_WITH} SELECT list_id, vec_id FROM c",
    "assign_nearest": f"{_WITH} SELECT vec_id, list_id, round(dist, 6) AS dist FROM a",
    "list_counts": f"{_WITH} SELECT list_id, count FROM l",
    "kmeans_update_step": f"{_WITH} SELECT list_id, pos, round(sum(x) / count(*), 6) AS value FROM (SELECT list_id, unnest(range(len(v)))::BIGINT AS pos, unnest(v)::DOUBLE AS x FROM a) GROUP BY 1, 2",
    "kmeans_mse": f"{_WITH} SELECT count(*)::BIGINT AS n, round(sum(dist) / count(*), 6) AS mse FROM a",
    "layout_extents": f"{_WITH} SELECT list_id, count, list_pages, start_page FROM x",
    "posting_slots": f"{_WITH}, o AS (SELECT list_id, vec_id, row_number() OVER (PARTITION BY list_id ORDER BY vec_id) - 1 AS slot FROM a) SELECT list_id, slot, vec_id, (start_page + slot // {_L.entries_per_page})::BIGINT AS page, (slot % {_L.entries_per_page} * {_L.entry_bytes})::BIGINT AS \"offset\" FROM o JOIN x USING (list_id)",
    "coarse_probe": f"{_WITH} SELECT query_id, probe_rank, list_id, round(cdist, 6) AS cdist FROM p WHERE probe_rank <= {NPROBE}",
    "ivf_search_batch": f"{_WITH} SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM i",
    "ivf_search_expression": f"{_WITH} SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM i",
    "ivf_full_probe_equals_exact": f"{_WITH} SELECT hits, total, hits / total AS recall FROM ({_RECALL.format(found='s')})",
    "recall_at_k": f"{_WITH} SELECT hits, total, round(hits / total, 6) AS recall FROM ({_RECALL.format(found='i')})",
    "recall_by_nprobe": f"{_WITH}, every AS (SELECT nprobe, query_id, vec_id FROM s, (SELECT unnest({list(PROBES)})::BIGINT AS nprobe) WHERE probe_rank <= nprobe QUALIFY row_number() OVER (PARTITION BY nprobe, query_id ORDER BY dist, vec_id) <= {K}) SELECT nprobe, count(t.vec_id)::BIGINT AS hits, (SELECT count(*) FROM t)::BIGINT AS total, round(count(t.vec_id) / (SELECT count(*) FROM t), 6) AS recall FROM every LEFT JOIN t ON t.query_id = every.query_id AND t.vec_id = every.vec_id GROUP BY nprobe",
    "scan_fraction": f"{_WITH} SELECT query_id, sum(count)::BIGINT AS candidates, round(sum(count) / (SELECT n FROM n), 6) AS fraction FROM p JOIN l USING (list_id) WHERE probe_rank <= {NPROBE} GROUP BY query_id",
    "page_access_trace": f"{_WITH} SELECT * FROM trace",
    "open_page_trace": f"{_WITH} SELECT seq, -1::BIGINT AS query_id, (CASE WHEN seq = 0 THEN 0 ELSE 1 + (nlist + {_L.centroids_per_page - 1}) // {_L.centroids_per_page} + (seq - 1) // {_L.extents_per_page} END)::BIGINT AS page, 0::BIGINT AS readahead FROM (SELECT nlist, unnest(range(nlist + 1))::BIGINT AS seq FROM n)",
    "scatter_page_trace": f"{_WITH}, o AS (SELECT list_id, vec_id, row_number() OVER (PARTITION BY list_id ORDER BY vec_id) - 1 AS slot FROM a) SELECT vec_id AS seq, (start_page + slot // {_L.entries_per_page})::BIGINT AS page FROM o JOIN x USING (list_id)",
    "trace_disk_mib": f"{_WITH} SELECT query_id, count(*)::BIGINT AS pages, round(count(*) * 4096 / (1024.0::DOUBLE * 1024.0::DOUBLE), 6) AS mib FROM trace GROUP BY query_id",
    "latency_p95_lower_rank": f"WITH m AS (SELECT unnest({LATENCIES})::DOUBLE AS ms) SELECT round(avg(ms), 6) AS mean_ms, list_sort(list(ms))[1 + floor(0.95::DOUBLE * (count(*) - 1))::BIGINT] AS p95_ms FROM m",
    "kmeans_train": f"{_WITH}, {_TRAIN} SELECT list_id, pos, round(x::DOUBLE, 5) AS value FROM u{ITERS - 1}",
    "build_index_roundtrip": f"{_WITH}, {_BUILT} SELECT list_id, slot, vec_id, (start_page + slot // {_L.entries_per_page})::BIGINT AS page, (slot % {_L.entries_per_page} * {_L.entry_bytes})::BIGINT AS \"offset\" FROM ko JOIN kx USING (list_id)",
    "ivf_search_written": f"{_WITH}, {_BUILT} SELECT query_id, rank, vec_id, round(away, 6) AS dist FROM ki",
    "ivf_search_joined": f"{_WITH}, {_BUILT} SELECT query_id, rank, vec_id, round(away, 6) AS dist FROM ki",
    "rawvec_roundtrip": "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings",
    "cache_lru_exact": f"{_WITH}, b AS (SELECT seq, page, lag(seq) OVER (PARTITION BY page ORDER BY seq) AS before, lead(seq) OVER (PARTITION BY page ORDER BY seq) AS later FROM trace), h AS (SELECT a.seq, count(o.seq) AS between_ FROM b a LEFT JOIN b o ON o.seq > a.before AND o.seq < a.seq AND (o.later IS NULL OR o.later > a.seq) WHERE a.before IS NOT NULL GROUP BY a.seq) SELECT count(*) FILTER (between_ < 64)::BIGINT AS hits, ((SELECT count(*) FROM trace) - count(*) FILTER (between_ < 64))::BIGINT AS misses FROM h",
}
