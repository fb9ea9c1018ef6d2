"""Token counts without token ids.

A text is cut into pre-tokens that no piece of the vocabulary can span. Pieces are
counted once for each distinct pre-token that a worker meets; each document's
pre-token frequencies are joined to those counts and summed. The join is against a
dictionary in the worker, so nothing is shuffled: a document's row leaves the task
that read it.

Defined cases: a null or empty text has no tokens; ids may be null and may repeat (each
row is counted by itself); other columns are ignored, whatever their names; an empty
table gives an empty result. Texts are never cut short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: Most pre-tokens a worker remembers; beyond it the dictionary starts anew, which only costs time.
REMEMBERED = 300_000
#: Longer pre-tokens (in characters) are counted but not remembered.
LONGEST = 64


class PieceCounter:
    """Pieces of a sentencepiece BPE model, counted by pre-token.

    The model must mark spaces only at the start of a piece, which is checked; then
    every maximal run of spaces starts a pre-token and merges never cross its left
    edge. Line feeds are in no piece but their own byte's and so stand alone.
    """

    PRE = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces span white space; pre-tokens can't be counted apart")
        self.base = len(self.model.encode("\n"))
        self.known: dict[str, int] = {}

    def learn(self, tokens: Iterable[str]) -> dict[str, int]:
        """Piece counts of distinct pre-tokens: known ones and those just counted."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        # Behind a line feed a pre-token is encoded as inside a text, without the mark that starts one.
        counts = [len(ids) - self.base for ids in self.model.encode(["\n" + t for t in new], num_threads=1)] if new else []
        self.known.update((t, n) for t, n in zip(new, counts) if len(t) <= LONGEST)
        return {t: n for t, n in zip(new, counts) if len(t) > LONGEST}

    def frequencies(self, text: str | None) -> Counter:
        return Counter(self.PRE.findall(("▁" + text).replace(" ", "▁"))) if text else Counter()

    def count(self, texts: list[str | None]) -> list[int]:
        tables = [self.frequencies(t) for t in texts]
        long = self.learn(set().union(*tables) if tables else ())
        get = self.known.get if not long else lambda t: self.known.get(t) or long[t]
        return [sum(get(t) * n for t, n in table.items()) for table in tables]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model_path)
        for part in slices(batches, "text"):
            counts = pieces.count(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), part.column(2)], ["id", "n", "b"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("b"))
    return rows.mapInArrow(run, f"id {kind}, n long, b long").select(
        F.col("id").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit")
    )
