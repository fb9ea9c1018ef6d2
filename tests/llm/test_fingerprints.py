import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vecloom.llm import fingerprints as fp


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_unscaled_likeness_is_jaccard(spark):
    rnd = random.Random(3)
    words = "a b c d e f g".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in texts[:12] for b in texts], "a string, b string")
    s = pairs.select("a", "b", fp.sketch(F.col("a"), scaled=1).alias("x"), fp.sketch(F.col("b"), scaled=1).alias("y"))
    for r in s.select("a", "b", fp.likeness(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("x"), F.col("y")).alias("c"), F.size("x").alias("n")).collect():
        x, y = shingles(r["a"]), shingles(r["b"])
        assert r["n"] == len(x)
        assert r["j"] == pytest.approx(len(x & y) / len(x | y)) and r["c"] == pytest.approx(len(x & y) / len(x))


def test_threshold_and_merge(spark):
    rnd = random.Random(4)
    a, b = (" ".join(str(rnd.randrange(10**6)) for _ in range(4000)) for _ in range(2))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string").select(*(fp.sketch(F.col(c)).alias(c) for c in "abc"))
    r = df.select("*", fp.merge(F.col("a"), F.col("b")).alias("m"), fp.containment(F.col("a"), F.col("c")).alias("in_c")).first()
    assert 400 < len(r["a"]) < 600 and r["a"] == sorted(r["a"])
    assert r["in_c"] == 1.0
    # Only the four shingles over the seam are missing.
    assert set(r["m"]) <= set(r["c"]) and len(set(r["c"]) - set(r["m"])) <= 4


def test_small_part_of_a_long_text(spark):
    rnd = random.Random(5)
    long = [str(rnd.randrange(10**6)) for _ in range(50_000)]
    part = long[20_000:21_500]
    df = spark.createDataFrame([(" ".join(part), " ".join(long))], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    assert df.select(fp.containment(F.col("a"), F.col("b"))).first()[0] > 0.95


@pytest.mark.parametrize("per_span", [1, 3, 2000])
def test_next_and_edited(spark, odd_rows, per_span, monkeypatch):
    rows = [(i, t) for i, t in odd_rows if i is not None and i not in (310, 311)] + [(-5, "first words of all"), (10**15, "very far away")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id long, span long").repartition(4)
    whole = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda d, i, t: whole(d, i, t, per_span))
    got = {r["doc_id"]: r for r in fp.compare_edited(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[k - 1][1] or ""
        half = len(t) // 2
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and (got[i]["near_next"] == 1) == (got[i]["fingerprint"] == got[order[k - 1][0]]["fingerprint"])
    assert got[200]["fingerprint"] == got[201]["fingerprint"] == got[3]["fingerprint"] and got[300]["fingerprint"] == got[301]["fingerprint"]


def test_repeated_and_null_ids(spark, odd, nothing):
    assert fp.compare_edited(odd).count() == odd.count()
    assert fp.compare_edited(nothing).count() == 0
    one = fp.compare_edited(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a b"[:7]).hexdigest()


def test_no_python(spark, odd):
    plan = fp.compare_edited(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
