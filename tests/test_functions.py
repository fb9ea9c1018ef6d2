import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import Layout, human_bytes, kernels, l2sq, mb_to_frames, norm, normalized, register

SCHEMA = "a array<float>, b array<float>"


def test_distance_and_norm(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0]), ([0.0, 0.0], [0.0, 0.0])], SCHEMA)
    rows = df.select(l2sq("a", "b").alias("d"), norm("b").alias("n"), normalized("b").alias("u")).collect()
    assert [r["d"] for r in rows] == [25.0, 0.0]
    assert rows[0]["n"] == pytest.approx(52**0.5)
    assert rows[0]["u"] == pytest.approx([4 / 52**0.5, 6 / 52**0.5], rel=1e-6)
    assert rows[1]["u"] == [0.0, 0.0]


def test_sql_function_is_inlined(spark):
    register(spark)
    spark.createDataFrame([([1.0], [3.0])], SCHEMA).createOrReplaceTempView("pairs")
    df = spark.sql("SELECT l2sq(a, b) AS d FROM pairs ORDER BY d LIMIT 1")
    assert df.first()["d"] == 4.0
    plan = df._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_other_length_is_null(spark):
    assert spark.createDataFrame([([1.0], [3.0, 1.0])], SCHEMA).select(l2sq("a", "b").alias("d")).first()["d"] is None


def test_layout():
    layout = Layout(128, 2048)
    assert (layout.entry_bytes, layout.entries_per_page, layout.centroids_per_page, layout.centroid_pages) == (520, 7, 8, 256)
    assert (layout.extents_per_page, layout.extent_pages, layout.lists_start) == (256, 8, 265)
    assert Layout(1022, 1).entries_per_page == 1
    with pytest.raises(ValueError, match="1022"):
        Layout(1023, 1)
    with pytest.raises(ValueError):
        Layout(0, 1)


def test_layout_columns(spark):
    layout = Layout(64, 4)
    row = spark.range(1).select(layout.list_pages(F.lit(16)).alias("p"), layout.list_pages(F.lit(0)).alias("none"), layout.entry_page(F.lit(9), F.lit(16)).alias("at"), layout.entry_offset(F.lit(16)).alias("o")).first()
    assert tuple(row) == (2, 0, 10, 264)


def test_reports():
    assert human_bytes(1536) == "1.5 KiB" and human_bytes(3 * 1024**4) == "3.0 TiB" and human_bytes(10) == "10.0 B"
    assert mb_to_frames(0) == 8 and mb_to_frames(2) == 512


def test_nearest_is_exact_and_breaks_ties_by_id():
    rows = np.array([[0, 0], [1, 0], [1, 0], [0, 1]], np.float32)
    q, ids, d = kernels.nearest(np.zeros((1, 2), np.float32), rows, np.array([9, 8, 3, 5]), 3)
    assert ids.tolist() == [9, 3, 5] and d.tolist() == [0, 1, 1]
    far = np.float32(1e6) + np.random.default_rng(0).standard_normal((500, 16)).astype(np.float32)
    q, ids, d = kernels.nearest(far[:20], far, np.arange(500), 5)
    for i in range(20):
        own = kernels.exact(np.broadcast_to(far[i], far.shape), far)
        assert ids[q == i].tolist() == np.lexsort((np.arange(500), own))[:5].tolist()
