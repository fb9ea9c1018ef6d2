import random

import duckdb
import pytest

from vecloom.llm import mixing


def filled(sizes, weights=(1, 2, 3)):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    rest = float(total)
    while rest > 1e-9 and left:
        share = rest / sum(w[s] for s in left)
        for s in left:
            target[s] += share * w[s]
        rest = sum(max(0.0, target[s] - 3 * sizes[s]) for s in left)
        for s in list(left):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                left.discard(s)
    return target


def made(spark, n, seed, sources):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rnd.paretovariate(1.1) * 3)), rnd.choices(sources, [50, *[3] * (len(sources) - 1)])[0]) for i in range(n)]
    rows += [(n, None, sources[0]), (n + 1, "", sources[-1]), (None, "a b", sources[0]), (5, "a b c", sources[1]), (5, "a b c", sources[1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


@pytest.mark.parametrize("sources", [["s1", "s2", "s3", None, "é", "Z"], ["a", "b"], ["x", None]])
def test_targets_and_words(spark, sources):
    rows, docs = made(spark, 800, 3, sources)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    by = {}
    for r in mixing.plan(docs).collect():
        assert r["__mix_source_size"] == sizes[r["source"]]
        assert r["__mix_target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["__mix_copies"] <= 3
        by[r["source"]] = by.get(r["source"], 0) + r["__mix_copies"] * r["__mix_size"]
    longest = max(len((t or "").split()) for _, t, _ in rows)
    for s in by:
        assert abs(by[s] - want[s]) <= max(0.05 * want[s], 2 * longest)


def test_reruns_agree_and_match_sql(spark):
    rows, docs = made(spark, 500, 8, ["s1", "s2", "s3", None])
    a = sorted(map(str, map(tuple, mixing.taken(docs).collect())))
    assert a == sorted(map(str, map(tuple, mixing.taken(docs.repartition(11)).collect())))
    connection = duckdb.connect()
    connection.register("docs", docs.toArrow())
    b = connection.sql(mixing.SQL.format(docs="docs")).fetchall()
    assert a == sorted(map(str, b))


def test_mixture_is_the_plan(spark):
    _, docs = made(spark, 200, 1, ["s1", "s2", "s3"])
    docs = docs.selectExpr("*", "1 AS size", "2 AS n")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    plan = mixing.plan(docs).selectExpr("sum(__mix_copies)").first()[0]
    assert out.count() == plan


def test_empty(spark, nothing):
    assert mixing.taken(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.taken(none).collect()] == [(0, 0, 0.0, 0)] * 2
