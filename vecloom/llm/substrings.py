"""Substring dedup by suffix automata of reference shards.

A window is 13 consecutive words. A word is removed if a window that covers it also
starts in a document with a smaller id. Candidate windows come from shared anchors (see
``passages``), whose contexts make a shard for each anchor: first of each slice of texts, then
of all slices, dealt by anchor, so that equal windows meet. A shard goes through its documents by id: each context is streamed
through the suffix automaton of all smaller documents' contexts, whose matching
statistics are the longest match that ends at each word; where they reach 13, the
maximal span is removed. Then the context joins the automaton, unless every
window of it was there. Automata are of one anchor each, never broadcast, and compare words, not hashes. Windows of
an anchor that very many slices of texts have are dealt one by one.

Defined cases: a null or empty text has no words; a null id is greater than every other
and never smaller than another null; rows of equal id and text are one document; words
are never lower-cased or cut; columns besides those named are carried along or ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import lean, slices
from .passages import Texts, Words

WINDOW, GRAM = 13, 6


class Automaton:
    """A suffix automaton of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the words up to ``word`` behind p, taken out of q where q holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p != -1:
                self.link[last] = self._split(p, word, self.next[p][word])

    def matches(self, words: list[bytes]) -> list[int]:
        """Matching statistics: the longest match that ends at each word."""
        state, n, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(word)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def spans(statistics: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal runs of words that matches of at least ``size`` words cover."""
    found: list[tuple[int, int]] = []
    for i, n in enumerate(statistics):
        if n >= size:
            if found and i + 1 - size <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i + 1 - size, i + 1))
    return found


def _sent(ids: list, members: list[int]) -> list[int]:
    """Of equal contexts in a slice, those of the smallest document; the automaton of the slice has matched the others."""
    least = min(ids)
    return [m for i, m in zip(ids, members) if i == least]


def _resolve(size: int):
    def resolve(routes, contexts, anchors, nearests, ids, none) -> Iterator[tuple]:
        order = np.lexsort((ids, none, routes))
        edges = np.flatnonzero(np.r_[True, routes[order][1:] != routes[order][:-1], True])
        name = [*zip(none.tolist(), ids.tolist())]
        out: list[tuple[int, int, int]] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows = order[a:b].tolist()
            if name[rows[0]] == name[rows[-1]]:
                continue
            shard, waiting, now = Automaton(), [], None
            whole: dict[bytes, int] = {}
            for row in rows:
                if name[row] != now:
                    for words in waiting:
                        shard.add(words)
                    waiting, now = [], name[row]
                text = contexts[row]
                if text in whole:  # the automaton has matched every window of it before, and only grows
                    out.append((row, 0, whole[text]))
                    continue
                words = text.split(b" ")
                statistics = shard.matches(words)
                out += [(row, i, j) for i, j in spans(statistics, size)]
                # Spans that touch may cover all words though windows between them are new.
                if any(n < size for n in statistics[size - 1 :]):
                    waiting.append(words)
                else:
                    whole[text] = len(words)
            if len(out) > 50_000:
                yield tuple(map(np.array, zip(*out)))
                out = []
        if out:
            yield tuple(map(np.array, zip(*out)))

    return resolve


def remove(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` without its text column, and n_words, n_removed, kept_sha256, and with keep_text __kept.

    __kept is the text itself where nothing is removed, else its kept words joined by spaces.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.lit(None).cast("struct<x:int>")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = passages.keyed(docs, id_col, text_col, rest)
    found, hot = passages.shared(rows, Words, size, GRAM, passages.hot_from(rows))
    sent = passages.contexts(rows, found, Words, size, GRAM, _resolve(size), _sent, hot)
    removed = passages.resolved(sent, _resolve(size))
    joined = passages.with_found(rows, removed)
    schema = f"id {kind}, rest {joined.schema['rest'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", passages.SLICE):
            words = Words(Texts(part.column(2)))
            data, starts, ends = words.spaced()
            n, gone, hashes, texts = [], [], [], []
            found = passages.arrays(part.column(4), passages.SPAN_KINDS)
            whole = part.column(2).to_pylist() if keep_text else []
            for i, (a, b) in enumerate(zip(words.bounds.tolist(), words.bounds[1:].tolist())):
                out = passages.covered(b - a, found[i])
                kept = b" ".join(data[starts[a + x] : ends[a + y - 1]] for x, y in passages.runs(~out))
                n.append(b - a)
                gone.append(int(out.sum()))
                hashes.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode() if gone[-1] else whole[i])
            columns = [part.column(1), part.column(3), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes)] + [pa.array(texts, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, ["id", "rest", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    out = joined.select("key", "id", "text", "rest", "found").mapInArrow(finish, schema)
    named = {"n_words": "n_words", "n_removed": "n_removed", "kept_sha256": "kept_sha256"} | ({"kept": "__kept"} if keep_text else {})
    return out.select(F.col("id").alias(id_col), *(F.col("rest").getField(c).alias(c) for c in others), *(F.col(a).alias(f"__{a}" if a in docs.columns else b) for a, b in named.items()))
