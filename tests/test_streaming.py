from vecloom.operators import exact, index
from vecloom.sources import generate
from vecloom.streaming import stream_search


def test_stream_of_queries(spark, tmp_path):
    v = generate.clustered(spark, 1000, 8, 10)
    built = index.build_index(v, str(tmp_path / "index"), 10)
    queries = generate.workload(v, 30).drop("vec_id")
    queries.write.parquet(str(tmp_path / "queries"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "queries"))
    stream_search(built, stream, 5, 10, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "rank", "vec_id")
    want = exact.exact_search(v, queries, 5).select("query_id", "rank", "vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
