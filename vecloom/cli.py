"""Tools: ``python -m vecloom.cli gen | build | query | bench``.

Exit codes: 1 for an error, 2 for a wrong call.
"""

from __future__ import annotations

import argparse
import resource
import sys
import time
from collections.abc import Sequence

from .functions import human_bytes, mb_to_frames
from .operators import cache, exact, index, metrics, search
from .session import local_session
from .sources import generate, rawvec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vecloom")
    p.add_argument("--cpus", default="*")
    sub = p.add_subparsers(dest="tool", required=True)
    g = sub.add_parser("gen", help="synthetic clustered vectors")
    g.add_argument("out")
    g.add_argument("--n", type=int, default=500_000)
    g.add_argument("--dim", type=int, default=128)
    g.add_argument("--clusters", type=int, default=1000)
    g.add_argument("--noise", type=float, default=0.15)
    g.add_argument("--seed", type=int, default=1234)
    b = sub.add_parser("build", help="an index of vectors")
    b.add_argument("raw")
    b.add_argument("index")
    b.add_argument("--nlist", type=int, default=0)
    b.add_argument("--sample", type=int, default=0)
    b.add_argument("--iters", type=int, default=10)
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--trainer", choices=("lloyd", "mllib"), default="lloyd")
    q = sub.add_parser("query", help="the vectors nearest to a row")
    q.add_argument("index")
    q.add_argument("--raw", required=True)
    q.add_argument("--row", type=int, default=0)
    q.add_argument("--k", type=int, default=10)
    q.add_argument("--nprobe", type=int, default=8)
    r = sub.add_parser("bench", help="throughput, recall and page accesses of a workload")
    r.add_argument("index")
    r.add_argument("--raw", required=True)
    r.add_argument("--queries", type=int, default=200)
    r.add_argument("--k", type=int, default=10)
    r.add_argument("--nprobe", type=int, default=8)
    r.add_argument("--cache-mb", type=float, default=8.0)
    r.add_argument("--policies", default="clock,lru,lru2")
    r.add_argument("--gt", type=int, default=32)
    r.add_argument("--noise", type=float, default=0.05)
    r.add_argument("--seed", type=int, default=7)
    return p


def read(spark, path: str):
    """Vectors of a raw file or folder, or of a Parquet folder (``.parquet``)."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else rawvec.read_rawvec(spark, path)


def run(a: argparse.Namespace) -> None:
    spark = local_session(a.cpus)
    start = time.monotonic()
    if a.tool == "gen":
        made = generate.clustered(spark, a.n, a.dim, a.clusters, a.noise, a.seed)
        if a.out.rstrip("/").endswith(".parquet"):
            made.write.mode("overwrite").parquet(a.out)
        else:
            rawvec.write_rawvec(made, a.out)
        print(f"{a.n} vectors of {a.dim} values, {human_bytes(4.0 * a.n * a.dim)}, in {time.monotonic() - start:.1f} s")
    elif a.tool == "build":
        built = index.build_index(read(spark, a.raw), a.index, a.nlist, a.sample, a.iters, a.seed, trainer=a.trainer)
        print(f"{built.n} vectors of {built.dim} values in {built.nlist} lists, in {time.monotonic() - start:.1f} s")
    elif a.tool == "query":
        built = index.load_index(spark, a.index)
        row = exact.point_lookup(read(spark, a.raw), a.row).selectExpr("vec_id AS query_id", "embedding")
        for r in search.ivf_search(built, row, a.k, a.nprobe).orderBy("rank").collect():
            print(f"{r['rank']:4d}  {r['vec_id']:10d}  {r['dist']:.6f}")
    else:
        built = index.load_index(spark, a.index)
        queries = generate.workload(read(spark, a.raw), a.queries, a.noise, a.seed).drop("vec_id").persist()
        asked = queries.filter(f"query_id < {min(a.gt, a.queries)}")
        truth = exact.exact_search(read(spark, a.raw), asked, a.k)
        search.ivf_search(built, queries, a.k, a.nprobe).count()  # a first run, which also starts workers
        times = []
        for _ in range(3):
            start = time.monotonic()
            search.ivf_search(built, queries, a.k, a.nprobe).write.format("noop").mode("overwrite").save()
            times.append(time.monotonic() - start)
        hits = metrics.recall(search.ivf_search(built, asked, a.k, a.nprobe), truth).first()
        alone = []
        for i in range(min(a.gt, a.queries, 20)):
            start = time.monotonic()
            search.ivf_search(built, queries.filter(f"query_id = {i}"), a.k, a.nprobe).collect()
            alone.append(1000 * (time.monotonic() - start))
        probes = search.coarse_probe(built, queries, a.nprobe).persist()
        part = search.candidates(built, probes).selectExpr(f"avg(candidates) / {built.n} AS f").first()["f"]
        print(f"{a.queries} queries a batch, k {a.k}, nprobe {a.nprobe} of {built.nlist}: {a.queries / min(times):.1f} queries a second, recall {hits['recall']:.3f}, {100 * part:.2f} % of vectors compared")
        if alone:
            print(f"{len(alone)} queries one by one: mean {sum(alone) / len(alone):.1f} ms, p95 {metrics.lower_rank_of(alone, 0.95):.1f} ms")
        frames = mb_to_frames(a.cache_mb)
        for r in cache.simulate(cache.page_trace(built, probes), a.policies.split(","), [frames]).orderBy("policy").collect():
            rate = 100 * r["hits"] / max(1, r["hits"] + r["misses"])
            print(f"{r['policy']:6s} {frames} frames: hits {rate:.1f} %, evictions {r['evictions']}, read {r['disk_reads']} pages ({human_bytes(4096.0 * r['disk_reads'])})")
        print(f"peak memory of the driver's Python: {human_bytes(1024.0 * resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)}")


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        run(a)
    except Exception as e:  # a tool says what went wrong and fails
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
