"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all ways to cut it into pieces, found by the
forward algorithm; a text's score is the sum of its words' log-probabilities, and the
language with the highest score wins. Probabilities come from expectation maximisation
with the forward and backward sums, over a sample of labelled documents of fixed size.

Words are maximal runs of letters (Unicode category L), lower-cased. Each is scored once for
each batch of documents and joined to the batch's word frequencies; the forward sums of words
of one length run together in numpy, and as logarithms where a word is too unlikely for doubles.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to
the first language by name; ids may be null and may repeat; null languages are not
learned; without labelled rows every text is ``und``; other columns are ignored, whatever
their names; an empty table gives an empty result. Words of more than LONGEST letters
are scored in stretches of so many letters; nothing is dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices

#: Letters, and numbers like ½ and Ⅷ, which \w has too and which ``word_table`` takes out again.
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Labelled documents to learn from, of each language: the bound of the fitted sample.
DOCS_PER_LANGUAGE = 250
ROUNDS = 2
LONGEST = 48
#: Most words that a worker remembers; beyond it the table starts anew, which only costs time.
REMEMBERED = 400_000
#: A factor for each letter, about the inverse of its probability.
TILT = 1e4
#: Pseudo-count of every piece in every language, and the probability of a letter that is no piece.
SMOOTHING, UNKNOWN = 0.1, 1e-8


class Pieces:
    """A vocabulary of pieces, and words of equal length cut in all ways at once.

    Substrings are looked up by a 64-bit polynomial hash that is extended by one letter
    at a time for all words together; words drop out where no piece starts so.
    """

    BASE = np.uint64(0x9E3779B97F4A7C15)
    FILTER = 20

    def __init__(self, pieces: list[str]) -> None:
        self.unknown = len(pieces)
        self.lengths = np.array([*map(len, pieces), 1], np.float64)
        starts = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        found = {p: i for i, p in enumerate(pieces)}
        hashes = np.array([self._hash(s) for s in starts], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        # The piece that a start is, or -1 where it is only a start.
        self.piece = np.array([found.get(s, -1) for s in starts], np.int64)[order]
        self.maybe = np.zeros(1 << self.FILTER, bool)
        self.maybe[self._slot(self.hashes)] = True

    @classmethod
    def _hash(cls, text: str) -> int:
        value = 0
        for c in text:
            value = (value * int(cls.BASE) + ord(c)) & ((1 << 64) - 1)
        return value

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.FILTER)).astype(np.int64)

    @classmethod
    def from_sentencepiece(cls, path: str) -> Pieces:
        """The lower-cased letter pieces of a sentencepiece model, with ▁ for a word's start."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i))
        return cls(sorted({p for p in found if (p.removeprefix("▁") or "a").isalpha()}))

    def cuts(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces), by from, for words of one length, each behind a ▁.

        A letter that is no piece is cut off by itself as the unknown piece.
        """
        size, n = len(words[0]), len(words)
        codes = np.empty((size + 1, n), np.uint64)
        codes[0] = ord("▁")
        codes[1:] = np.array(words, f"<U{size}").view(np.uint32).reshape(n, size).T
        for i in range(size + 1):
            rows, value = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, size + 2):
                value = value * self.BASE + codes[j - 1, rows]
                alive = np.flatnonzero(self.maybe[self._slot(value)])
                at = np.minimum(np.searchsorted(self.hashes, value[alive]), len(self.hashes) - 1)
                hit = self.hashes[at] == value[alive]
                alive, piece = alive[hit], self.piece[at[hit]]
                is_piece = piece >= 0
                found = rows[alive[is_piece]]
                if j == i + 1 and found.size < n:
                    other = np.setdiff1d(rows, found, assume_unique=True)
                    yield i, j, other, np.full(other.size, self.unknown)
                if found.size:
                    yield i, j, found, piece[is_piece]
                rows, value = rows[alive], value[alive]
                if not rows.size:
                    break


def by_length(words: list[str], most: int = 20_000) -> Iterator[list[str]]:
    """Words in lists of one length."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for i in range(0, len(group), most):
            yield group[i : i + most]


def _sums(edges: list, size: int, n: int, weights: np.ndarray, logs: bool, forward: bool) -> np.ndarray:
    """Forward or backward sums by (place, word, ...); weights by piece, or with logs their logarithms."""
    table = np.full((size + 2, n, *weights.shape[1:]), -np.inf if logs else 0.0)
    table[0 if forward else -1] = 0 if logs else 1
    for i, j, rows, piece in edges if forward else reversed(edges):
        a, b = (i, j) if forward else (j, i)
        if logs:
            table[b, rows] = np.logaddexp(table[b, rows], table[a, rows] + weights[piece])
        else:
            table[b, rows] += table[a, rows] * weights[piece]
    return table


def _tilted(pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Probabilities times TILT for each letter, which keeps sums over long words in the range of doubles."""
    factors = TILT ** pieces.lengths
    return probabilities * (factors[:, None] if probabilities.ndim > 1 else factors)


def _in_range(total: np.ndarray) -> np.ndarray:
    """Words whose sums have neither vanished nor overflowed."""
    good = (total > 1e-200) & (total < 1e200)
    return good.all(axis=1) if good.ndim > 1 else good


def score_words(pieces: Pieces, words: list[str], probabilities: np.ndarray) -> np.ndarray:
    """Log-probability by (word, language) of words of one length; probabilities by (piece, language).

    Words whose sums leave the range of doubles are added up again as logarithms.
    """
    size = len(words[0])
    total = _sums([*pieces.cuts(words)], size, len(words), _tilted(pieces, probabilities), False, True)[-1]
    good = _in_range(total)
    with np.errstate(divide="ignore"):
        out = np.log(total) - (size + 1) * math.log(TILT)
    if not good.all():
        again = [w for w, g in zip(words, good.tolist()) if not g]
        out[~good] = _sums([*pieces.cuts(again)], size, len(again), np.log(probabilities), True, True)[-1]
    return out


def expected_counts(pieces: Pieces, words: list[str], freq: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one length, for one language's probabilities by piece."""
    uses = np.zeros(pieces.unknown + 1)

    def count(words: list[str], freq: np.ndarray, weights: np.ndarray, logs: bool) -> np.ndarray:
        edges, size = [*pieces.cuts(words)], len(words[0])
        alpha, beta = (_sums(edges, size, len(words), weights, logs, forward) for forward in (True, False))
        good = np.ones(len(words), bool) if logs else _in_range(alpha[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(good, freq if logs else freq / alpha[-1], 0.0)
        for i, j, rows, piece in edges:
            if logs:
                share = np.exp(alpha[i, rows] + weights[piece] + beta[j, rows] - alpha[-1, rows])
            else:
                share = alpha[i, rows] * weights[piece] * beta[j, rows]
            share = np.where(good[rows], share, 0.0)
            uses[:] += np.bincount(piece, share * weight[rows], minlength=uses.size)
        return good

    good = count(words, freq, _tilted(pieces, probabilities), False)
    if not good.all():
        count([w for w, g in zip(words, good.tolist()) if not g], freq[~good], np.log(probabilities), True)
    if not np.isfinite(uses).all():
        raise ArithmeticError("expected counts must be finite")
    return uses


def word_table(text: str | None) -> dict[str, int]:
    """Frequencies of a text's words, long ones in stretches."""
    found = Counter(LETTERS.findall(text.lower())) if text else Counter()
    for w in [w for w in found if not w.isalpha() or len(w) > LONGEST]:
        n = found.pop(w)
        for run in "".join(c if c.isalpha() else " " for c in w).split():
            for i in range(0, len(run), LONGEST):
                found[run[i : i + LONGEST]] += n
    return found


class Scorer:
    """Word scores by language, remembered in a table of bounded size."""

    def __init__(self, pieces: Pieces, probabilities: np.ndarray) -> None:
        self.pieces, self.probabilities = pieces, probabilities
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, probabilities.shape[1]))

    def learn(self, words: set[str]) -> None:
        if len(self.place) > REMEMBERED:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        n = len(self.place)
        if n + len(new) > len(self.scores):
            self.scores = np.vstack([self.scores[:n], np.zeros((len(new) + n // 2, self.scores.shape[1]))])
        for group in by_length(new):
            self.scores[n : n + len(group)] = score_words(self.pieces, group, self.probabilities)
            self.place.update(zip(group, range(n, n + len(group))))
            n += len(group)

    def text(self, table: dict[str, int]) -> np.ndarray:
        return np.fromiter(table.values(), float, len(table)) @ self.scores[[*map(self.place.__getitem__, table)]]


def posterior(total: np.ndarray) -> tuple[int, float]:
    """The language of the highest score, the first of equals, and its share of the posterior, languages alike before."""
    best = int(np.argmax(np.round(total, 6)))
    return best, min(1.0, 1 / sum(math.exp(min(0.0, max(-700.0, x))) for x in (total - total[best]).tolist()))


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """A vocabulary's pieces, made once for each worker."""
    return Pieces.from_sentencepiece(path)


class Model:
    """Languages in order and log-probabilities of their pieces."""

    def __init__(self, languages: list[str], probabilities: np.ndarray) -> None:
        self.languages, self.probabilities = languages, probabilities


def fit(docs: DataFrame, vocabulary_path: str, docs_per_language: int = DOCS_PER_LANGUAGE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in ``docs``, from at most docs_per_language documents of each.

    Those are the first by a hash of their id. What comes to the driver is a count for
    each language and piece.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= docs_per_language)
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 0)))
    chosen = chosen.select(F.col("id").alias("__id"), F.col("lang").alias("__lang"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("lang", "text").persist()
    pieces = pieces_of(vocabulary_path)
    counts = np.ones((pieces.unknown, len(languages)))
    probabilities = _normal(counts)
    try:
        for _ in range(rounds + 1):
            now = probabilities

            @lean
            def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = pieces_of(vocabulary_path)
                for part in slices(batches, "text"):
                    by: dict[str, Counter] = {}
                    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        by.setdefault(lang, Counter()).update(word_table(text))
                    for lang, table in by.items():
                        k = languages.index(lang)
                        got = sum((expected_counts(own, g, np.array([table[w] for w in g], float), now[:, k]) for g in by_length([*table])), np.zeros(own.unknown + 1))[:-1]
                        used = np.flatnonzero(got)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(used.size, k)), pa.array(used), pa.array(got[used])], ["k", "piece", "n"])

            counts = np.zeros_like(counts)
            for k, piece, n in sample.mapInArrow(expect, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect():
                counts[piece, k] = round(n, 6)
            probabilities = _normal(counts + SMOOTHING)
    finally:
        sample.unpersist()
    return Model(languages, probabilities)


def _normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces by language, and of an unknown letter."""
    return np.vstack([counts / counts.sum(axis=0), np.full((1, counts.shape[1]), UNKNOWN)])


def predict(docs: DataFrame, model: Model, vocabulary_path: str, text_col: str = "text", names: tuple[str, str] = ("__lang_pred", "__score")) -> DataFrame:
    """``docs`` with the predicted language and its share of the posterior added, under names that ``docs`` must not have."""
    session = docs.sparkSession
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"docs has the columns {sorted(clash)}")
    shared = session.sparkContext.broadcast((model.languages, model.probabilities))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probabilities = shared.value
        scorer = Scorer(pieces_of(vocabulary_path), probabilities)
        for part in slices(batches, text_col):
            tables = [word_table(t) if languages else {} for t in part.column(at).to_pylist()]
            scorer.learn(set().union(*tables))
            found = []
            for table in tables:
                if not table:
                    found.append((UNDETERMINED, 0.0))
                    continue
                best, share = posterior(scorer.text(table))
                found.append((languages[best], share))
            best, shares = zip(*found)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(shares, pa.float64())], [*part.schema.names, *names])

    return docs.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def trained_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows to learn from: crc32 of the id as text is not 1 modulo 3."""
    return docs.filter(F.crc32(F.col(id_col).cast("string")) % 3 != 1)


def identify(docs: DataFrame, vocabulary_path: str, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that aren't held out."""
    model = fit(trained_rows(docs), vocabulary_path, docs_per_language)
    out = predict(docs.select("doc_id", "text"), model, vocabulary_path)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
