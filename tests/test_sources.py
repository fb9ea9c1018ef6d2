import numpy as np
import pytest

from vecloom import cli
from vecloom.sources import generate, rawvec


def rows(df, by="vec_id"):
    return [(r[by], list(r["embedding"])) for r in df.orderBy(by).collect()]


def test_generated_vectors_do_not_depend_on_partitions(spark):
    a = generate.clustered(spark, 3000, 6, 9)
    assert a.count() == 3000 and rows(a)[:50] == rows(generate.clustered(spark, 3000, 6, 9).repartition(3))[:50]
    x = np.array([e for _, e in rows(generate.clustered(spark, 4000, 32, 3, 0.0))])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5) and len(np.unique(x.round(5), axis=0)) == 3
    with pytest.raises(ValueError):
        generate.clustered(spark, 10, 4, 0)
    assert generate.clustered(spark, 0, 4, 1).count() == 0


def test_workload(spark):
    v = generate.clustered(spark, 300, 8, 4)
    q = generate.workload(v, 50, 0.0, 3)
    own = dict(rows(v))
    assert q.count() == 50 and all(own[r["vec_id"]] == list(r["embedding"]) for r in q.collect())
    noisy = generate.workload(v, 50, 0.1, 3)
    assert rows(noisy, "query_id") == rows(generate.workload(v.repartition(5), 50, 0.1, 3), "query_id")


def test_raw_round_trip(spark, tmp_path):
    v = generate.clustered(spark, 2500, 5, 4)
    path = str(tmp_path / "raw")
    rawvec.write_rawvec(v, path, partitions=3)
    back = rawvec.read_rawvec(spark, path)
    assert rows(back) == rows(v)
    assert back.filter("vec_id = 2100").count() == 1
    rawvec.write_rawvec(v.filter("vec_id < 10"), path, partitions=1)
    assert rawvec.read_rawvec(spark, path).count() == 10
    one = str(tmp_path / "one.vec")
    rawvec.write_file(one, np.array([e for _, e in rows(v)], np.float32))
    assert rows(rawvec.read_rawvec(spark, one)) == rows(v)


def test_raw_damage(spark, tmp_path):
    path = str(tmp_path / "x.vec")
    rawvec.write_file(path, np.ones((4, 3), np.float32))
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-4])
    with pytest.raises(rawvec.FormatError):
        rawvec.header(path)
    open(path, "wb").write(whole[:10])
    with pytest.raises(rawvec.FormatError):
        rawvec.header(path)
    rawvec.write_file(path, np.ones((0, 3), np.float32))
    assert rawvec.read_rawvec(spark, path).count() == 0


def test_tools(spark, tmp_path, capsys):
    raw, built = str(tmp_path / "v"), str(tmp_path / "i")
    assert cli.main(["--cpus", "4", "gen", raw, "--n", "2000", "--dim", "8", "--clusters", "10"]) == 0
    assert cli.main(["--cpus", "4", "build", raw, built, "--nlist", "10"]) == 0
    assert cli.main(["--cpus", "4", "query", built, "--raw", raw, "--row", "3", "--k", "2"]) == 0
    assert capsys.readouterr().out.splitlines()[-2].split()[:2] == ["1", "3"]
    assert cli.main(["--cpus", "4", "bench", built, "--raw", raw, "--queries", "20", "--gt", "5"]) == 0
    assert "queries a second" in capsys.readouterr().out
    assert cli.main(["--cpus", "4", "query", str(tmp_path / "none"), "--raw", raw]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["query"])
    assert e.value.code == 2
