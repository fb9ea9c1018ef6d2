"""Structured Streaming: every micro-batch of queries is searched as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.search import ivf_search


def stream_search(index: Index, queries: DataFrame, k: int, nprobe: int, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends (batch_id, query_id, rank, vec_id, dist) as Parquet for each micro-batch of (query_id, embedding).

    A batch is written to its own folder and overwritten if it is run again, so results
    come once.
    """

    def search(batch: DataFrame, batch_id: int) -> None:
        ivf_search(index, batch, k, nprobe).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
