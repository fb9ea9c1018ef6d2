"""A session for tools and tests on one machine; a cluster brings its own."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int | None = None, memory: str = "4g") -> SparkSession:
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # numpy in tasks, which are the parallel units
    n = partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("vecloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share, for tables that go when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
