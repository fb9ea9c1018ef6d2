"""A training-data pipeline over ``documents`` in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet to the shared folder and read again.

* language: documents without letters, and those whose language is less than even odds,
  go. Labels are learned from the stage's own rows, from a sample of fixed size.
* near_dedup: of each group of near copies the document of the smallest id stays. Near copies
  have a Jaccard similarity of 0.8 or more of their sets of five-word shingles.
* substring_dedup: words that a 13-word window of a smaller document covers go from the
  text, whose other words are then joined by spaces; n_chars follows. Documents left
  without a word go.
* mixing: documents are repeated or left out so that sources meet their target weights.
* byte_bpe: ids of every text, and hashes of them and of the bytes they decode to.

Defined cases, stage by stage. Null and empty texts: have no language and go in the first stage; in the
later ones, called by themselves, they equal each other and one of each group stays (near_dedup), stay as they are
(substring_dedup), are emitted like others (mixing) and have no ids (byte_bpe). Null ids: stay in
near_dedup; come after every other id in substring_dedup and never before each other; are ids like others elsewhere. Null languages
aren't learned; a null source is a source of its own. Ties: languages by name, near copies and shared windows by
the smallest id, equal sizes in a source by id and a hash of the text. Repeated rows: one of each id and text
stays (near_dedup); rows of equal id and text are one document (substring_dedup) and several (mixing, byte_bpe). Very long texts are handled
whole, in one task each. Extra columns may have any names; they are kept by all stages but the last. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from vecloom.llm import byte_bpe, language, mixing, simhash, substrings
from vecloom.llm.common import materialize

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5


def fresh(names: list[str], columns: list[str]) -> list[str]:
    """The names, each with underscores in front until ``columns`` doesn't have it, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and ``row`` with the others, so that no names clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*others).alias("row"))


def together(found: DataFrame, docs: DataFrame, used: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` again: those in ``used`` as given, the others from ``row``."""
    return found.select(*((used[c] if c in used else F.col("row").getField(c)).alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    best, share = fresh(["best", "share"], docs.columns)
    found = language.predict(docs, language.fit(docs, vocabulary), vocabulary, names=(best, share))
    return found.filter((F.col(best) != language.UNDETERMINED) & (F.col(share) >= LEAST_SCORE)).drop(best, share)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_copies(docs, width=5, similarity=0.8)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.remove(apart(docs, "doc_id", "text"), size=13, keep_text=True).filter("n_words = 0 or n_removed < n_words")
    n_chars = F.col("row").getField("n_chars")
    length = F.when(F.col("n_removed") > 0, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return together(found, docs, {"doc_id": F.col("doc_id"), "text": F.col("__kept"), "n_chars": length})


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    used = ("doc_id", "text", "source")
    return together(mixing.mix(apart(docs, *used), seed=42), docs, {c: F.col(c) for c in used})


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: SQL can't express the first three stages; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
