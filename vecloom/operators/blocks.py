"""Queries sent to all tasks, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that are sent to all tasks at once.
SENT = 64 << 20


def in_blocks(queries: DataFrame, dim: int, work: Callable[[np.ndarray, np.ndarray], DataFrame], id_col: str, vec: str, sent: int = SENT) -> DataFrame | None:
    """The union of work(ids, vectors) over blocks of the queries; None without queries.

    A block is collected and broadcast, and it is measured before: queries are cut by a
    hash of their id into blocks of about half of ``sent`` bytes, and a block that is still too
    large (ids that repeat) raises.
    """
    per = max(1, sent // (4 * max(dim, 1) + 8))
    rows = queries.select(F.col(id_col).cast("long").alias("i"), F.col(vec).cast("array<float>").alias("v"))

    def part(table: pa.Table) -> DataFrame:
        return work(table["i"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim))

    first = rows.limit(per + 1).toArrow()
    if first.num_rows <= per:
        return part(first) if first.num_rows else None
    blocks = -(-2 * queries.count() // per)
    parts = []
    for b in range(blocks):
        table = rows.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).limit(per + 1).toArrow()
        if table.num_rows > per:
            raise ValueError("too many queries have one id")
        if table.num_rows:
            parts.append(part(table))
    return reduce(DataFrame.unionByName, parts)
