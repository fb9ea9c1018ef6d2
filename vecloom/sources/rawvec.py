"""The ``rawvec`` data source: flat files of float32 vectors.

A file is ``u64 count, u32 dim, u32 reserved``, little-endian, then the values. A path is
a file, or a folder whose files follow one another by name. Ids are places in that order.
Reading is split into ranges of rows; every task of a write makes a file of its own, and the write
is committed by moving them into place. Paths must be reachable from all executors.
"""

from __future__ import annotations

import os
import shutil
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed format: the header, and vectors that are read at once.
HEADER = struct.Struct("<QII")
BATCH, PARTITION_BYTES = 1024, 64 << 20
SCHEMA = "vec_id long, embedding array<float>"


class FormatError(ValueError):
    """A file that isn't as its header says."""


def header(path: str) -> tuple[int, int]:
    """Count and dim of a file, checked against its size."""
    with open(path, "rb") as f:
        raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise FormatError(f"{path}: no header")
    n, dim, _ = HEADER.unpack(raw)
    size = os.path.getsize(path) - HEADER.size
    if n and not dim or size != n * dim * 4:
        raise FormatError(f"{path}: {size} bytes of values, the header says {n} vectors of {dim}")
    return n, dim


def files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".vec"))
    return [path]


@dataclass
class Rows(InputPartition):
    path: str
    first_id: int
    start: int
    stop: int
    dim: int


class RawReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.only: int | None = None

    def partitions(self) -> list[Rows]:
        found, first, dims = [], 0, set()
        for path in files(self.path):
            n, dim = header(path)
            dims |= {dim} if n else set()
            step = max(BATCH, PARTITION_BYTES // (4 * max(dim, 1)))
            for start in range(0, n, step):
                stop = min(n, start + step)
                if self.only is None:
                    found.append(Rows(path, first, start, stop, dim))
                elif first + start <= self.only < first + stop:
                    found.append(Rows(path, first, self.only - first, self.only - first + 1, dim))
            first += n
        if len(dims) > 1:
            raise FormatError(f"{self.path}: files of {sorted(dims)} values")
        return found or [Rows("", 0, 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.stop == part.start:
            return
        with open(part.path, "rb") as f:
            f.seek(HEADER.size + part.start * part.dim * 4)
            for start in range(part.start, part.stop, BATCH):
                n = min(BATCH, part.stop - start)
                values = np.frombuffer(f.read(n * part.dim * 4), "<f4")
                ids = np.arange(part.first_id + start, part.first_id + start + n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * part.dim + 1, part.dim, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["vec_id", "embedding"])


class LookupReader(RawReader):
    """The same with pushdown, which a session has to allow."""

    def pushFilters(self, filters):  # noqa: N802
        """An equality on the id is looked up by its place."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("vec_id",) and self.only is None:
                self.only = f.value
        yield from filters


@dataclass
class Written(WriterCommitMessage):
    path: str


class RawWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.waiting = f"{path.rstrip('/')}/_waiting"
        os.makedirs(self.waiting, exist_ok=True)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{self.waiting}/part-{context.partitionId():06d}-{context.taskAttemptId()}.vec"
        n, dim = 0, 0
        with open(path, "wb") as f:
            f.write(HEADER.pack(0, 0, 0))
            for row in rows:
                values = np.asarray(row["embedding"], "<f4")
                if n and len(values) != dim:
                    raise FormatError("vectors differ in length")
                dim = len(values)
                f.write(values.tobytes())
                n += 1
            f.seek(0)
            f.write(HEADER.pack(n, dim, 0))
        return Written(path)

    def commit(self, messages) -> None:
        if self.overwrite:
            for f in files(self.path):
                os.remove(f)
        have = len(files(self.path))
        for i, m in enumerate(sorted((m for m in messages if m is not None), key=lambda m: m.path)):
            os.replace(m.path, f"{self.path}/part-{have + i:06d}.vec")
        shutil.rmtree(self.waiting, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.waiting, ignore_errors=True)


class RawVec(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RawReader:
        return (LookupReader if self.options.get("lookup") == "true" else RawReader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RawWriter:
        return RawWriter(self.options["path"], overwrite)


def read_rawvec(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RawVec)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("rawvec").option("lookup", "true").load(path)


def write_rawvec(vectors: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None, id_col: str = "vec_id", vec: str = "embedding") -> None:
    """A folder of files in the order of ids, so that reading gives dense ids their own vectors."""
    vectors.sparkSession.dataSource.register(RawVec)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<float>").alias("embedding"))
    ordered = rows.repartitionByRange(partitions, "vec_id") if partitions else rows.repartitionByRange("vec_id")
    ordered.sortWithinPartitions("vec_id").write.format("rawvec").mode(mode).save(path)


def write_file(path: str, vectors: np.ndarray) -> None:
    """One file from an array, on this machine."""
    with open(path, "wb") as f:
        f.write(HEADER.pack(len(vectors), vectors.shape[1], 0))
        f.write(np.ascontiguousarray(vectors, "<f4").tobytes())
