"""Suffix-array dedup of byte strings.

Every byte that a 200-byte string covers which also starts elsewhere is removed.
Candidates come from shared anchors (see ``passages``); their contexts are compared within
each slice of texts and then dealt by anchor, so that equal strings meet in one task. The suffixes that start at the
anchor are sorted, and so are the prefixes that end there, read backwards: a mergesort
whose comparisons find the common extension by binary search over prefix polynomial
hashes, so each takes a logarithmic number of steps. All groups are sorted together, a
level of the mergesort at a time. Bytes are compared afterwards for every pair of
neighbours; after a collision the group's task sorts the bytes themselves.

With both orders and their common extensions, a string that reaches d bytes before the
anchor is repeated if another context shares its class on both sides: neighbours with a
common extension of d bytes before, and of 200 - d behind.

Defined cases: a null or empty text has no bytes; strings never span texts; rows of equal
id and text repeat each other; bytes needn't be cut between characters; columns besides
those named are ignored, whatever their names; an empty table gives an empty result.
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
from .passages import Bytes, Texts, powers

WINDOW, GRAM = 200, 32
#: Bytes of contexts that are sorted together, or one group.
TOGETHER = 1 << 20


class Suffixes:
    """Byte strings, each with an anchor; its sides are what follows it and, backwards, what is before."""

    def __init__(self, strings: list[bytes], anchors: np.ndarray) -> None:
        lengths = np.array([len(s) for s in strings], np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.cumsum(lengths) - lengths
        self.begin, self.at = begin, begin + anchors
        self.size = {1: lengths - anchors, -1: np.asarray(anchors, np.int64)}
        place = np.arange(len(self.data)) - np.repeat(begin, lengths)
        self.sums = np.r_[np.uint64(0), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[place], dtype=np.uint64)]
        self.inverse = powers(int(lengths.max()) + 1, True)

    def hashes(self, i: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
        """Of the first n bytes of a side."""
        low = self.at[i] if side > 0 else self.at[i] - n
        return (self.sums[low + n] - self.sums[low]) * self.inverse[low - self.begin[i]]

    def common(self, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
        """Common extensions, by binary search."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.size[side][i], self.size[side][j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes(i, mid, side) == self.hashes(j, mid, side)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def byte(self, i: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
        """The byte behind the first n of a side, -1 where there is none."""
        at = self.at[i] + n if side > 0 else self.at[i] - 1 - n
        return np.where(n < self.size[side][i], self.data[np.clip(at, 0, len(self.data) - 1)].astype(np.int64), -1)

    def before(self, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
        """Whether i sorts before j, or is as j and stands before it."""
        n = self.common(i, j, side)
        a, b = self.byte(i, n, side), self.byte(j, n, side)
        return (a < b) | (a == b) & (i < j)

    def sort(self, groups: np.ndarray, side: int) -> np.ndarray:
        """An order of the strings, by group and within it by a side; groups ascend."""
        order = np.arange(len(groups))
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[starts, len(groups)])
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            # Merge runs of this width: each string's place is its place in its run and its rank in the other.
            active = np.flatnonzero(size > width)
            offset = active - base[active]
            run = offset // width
            other = (run ^ 1) * width
            low, high = np.minimum(other, size[active]), np.minimum(other + width, size[active])
            first = low.copy()
            while (search := low < high).any():
                mid = (low + high) >> 1
                at = active[search]
                less = self.before(order[base[at] + mid[search]], order[at], side)
                low[search] = np.where(less, mid[search] + 1, low[search])
                high[search] = np.where(less, high[search], mid[search])
            to = base[active] + (run & ~1) * width + (offset - run * width) + low - first
            moved = order.copy()
            moved[to] = order[active]
            order = moved
            width *= 2
        return order

    def extensions(self, order: np.ndarray, groups: np.ndarray, side: int) -> np.ndarray:
        """Common extension of each string with the one before it in the order; -1 for a group's first."""
        same = groups[order][1:] == groups[order][:-1]
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(same) + 1
        out[at] = self.common(order[at - 1], order[at], side)
        return out

    def verified(self, order: np.ndarray, extensions: np.ndarray, side: int) -> bool:
        """Whether neighbours agree in just the bytes that their hashes say, and stand in order."""
        at = np.flatnonzero(extensions >= 0)
        i, j, n = order[at - 1], order[at], extensions[at]
        a, b = self.byte(i, n, side), self.byte(j, n, side)
        if not ((a < b) | (a == b) & (a == -1)).all():
            return False
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        back = (lambda x: np.repeat(self.at[x], n) + step) if side > 0 else (lambda x: np.repeat(self.at[x], n) - 1 - step)
        return bool((self.data[back(i)] == self.data[back(j)]).all())

    def plainly(self, groups: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The order and extensions from the bytes themselves."""
        def text(i: int) -> bytes:
            a, n = int(self.at[i]), int(self.size[side][i])
            return self.data[a : a + n].tobytes() if side > 0 else self.data[a - n : a][::-1].tobytes()

        order = np.array(sorted(range(len(groups)), key=lambda i: (groups[i], text(i), i)), np.int64)
        out = np.full(len(order), -1, np.int64)
        for k in range(1, len(order)):
            if groups[order[k]] == groups[order[k - 1]]:
                a, b = text(order[k - 1]), text(order[k])
                n = min(len(a), len(b))
                differ = np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))
                out[k] = differ[0] if differ.size else n
        return order, out

    def classes(self, groups: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        order = self.sort(groups, side)
        extensions = self.extensions(order, groups, side)
        return (order, extensions) if self.verified(order, extensions, side) else self.plainly(groups, side)


def repeated_windows(strings: list[bytes], groups: np.ndarray, anchors: np.ndarray, nearests: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of windows of distinct strings that another string of the group has too; groups ascend."""
    suffixes = Suffixes(strings, anchors)
    right, behind = suffixes.classes(groups, 1)
    left, ahead = suffixes.classes(groups, -1)
    found_s, found_o = [], []
    for d in range(int(nearests.min()), int(anchors.max()) + 1):
        # Classes of strings that share d bytes before the anchor, and size - d from it on.
        a, b = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        a[left] = np.cumsum(ahead < d)
        b[right] = np.cumsum(behind < size - d)
        own = np.flatnonzero((nearests <= d) & (d <= anchors))
        pair = a[own] * (len(strings) + 1) + b[own]
        order = np.argsort(pair, kind="stable")
        twin = np.zeros(len(own), bool)
        same = pair[order][1:] == pair[order][:-1]
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        found_s.append(own[twin])
        found_o.append(anchors[own[twin]] - d)
    return np.concatenate(found_s), np.concatenate(found_o)


def _sent(ids: list, members: list[int]) -> list[int]:
    """Equal contexts in a slice have decided each other there."""
    return []


def _resolve(size: int):
    def resolve(routes, contexts, anchors, nearests, ids, none) -> Iterator[tuple]:
        edges = np.flatnonzero(np.r_[True, routes[1:] != routes[:-1], True]).tolist()
        strings: list[bytes] = []
        groups: list[int] = []
        rows_of: list[list[int]] = []
        held = 0
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1:
                distinct: dict[bytes, list[int]] = {}
                for row in range(a, b):
                    distinct.setdefault(contexts[row], []).append(row)
                strings += distinct
                rows_of += distinct.values()
                groups += [a] * len(distinct)
                held += sum(map(len, distinct))
            if strings and (held > TOGETHER or b == edges[-1]):
                yield from decide(strings, np.array(groups), rows_of, anchors, nearests)
                strings, groups, rows_of, held = [], [], [], 0

    def decide(strings, groups, rows_of, anchors, nearests) -> Iterator[tuple]:
        # A context that came more than once is sorted twice, which is enough to find all of it repeated.
        times = np.array([min(2, len(r)) for r in rows_of])
        of = np.repeat(np.arange(len(strings)), times)
        twin = np.r_[False, of[1:] == of[:-1]]
        groups = groups[of]
        # Those alone in their group have nothing to be compared with.
        sizes = np.diff(np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not open_.size:
            return
        first = np.array([r[0] for r in rows_of])[of[open_]]
        string, offset = repeated_windows([strings[i] for i in of[open_].tolist()], groups[open_], anchors[first].astype(np.int64), nearests[first].astype(np.int64), size)
        once = ~twin[open_][string]
        string, offset = of[open_][string[once]], offset[once]
        if not string.size:
            return
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        new = np.r_[True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], len(string)] - 1
        many = np.array([len(r) for r in rows_of])[string[starts]]
        rows = np.array([row for i in string[starts].tolist() for row in rows_of[i]])
        yield rows, np.repeat(offset[starts], many), np.repeat(offset[stops] + size, many)

    return resolve


def remove(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), and with keep_bytes spans and kept.

    spans: the removed runs as array<struct<start, stop>>; kept: the other bytes, binary.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = passages.keyed(docs, id_col, text_col)
    found, hot = passages.shared(rows, Bytes, size, GRAM)
    sent = passages.contexts(rows, found, Bytes, size, GRAM, _resolve(size), _sent, hot)
    removed = passages.resolved(sent, _resolve(size))
    joined = passages.with_found(rows, removed)
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", starts array<long>, stops array<long>, kept binary" * keep_bytes

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", passages.SLICE):
            found = passages.arrays(part.column(3), passages.SPAN_KINDS)
            out = []
            for text, f in zip(part.column(2).to_pylist(), found):
                raw = (text or "").encode()
                gone = passages.covered(len(raw), f)
                spans = passages.runs(gone)
                kept = b"".join(raw[a:b] for a, b in passages.runs(~gone))
                row = (len(raw), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest())
                out.append(row + (([a for a, _ in spans], [b for _, b in spans], kept) if keep_bytes else ()))
            types = [*[pa.int64()] * 3, pa.string()] + [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()] * keep_bytes
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), types))], [x.split()[0] for x in schema.split(", ")])

    out = joined.select("key", "id", "text", "found").mapInArrow(finish, schema)
    plain = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*plain, *([F.arrays_zip(F.col("starts").alias("start"), F.col("stops").alias("stop")).alias("spans"), "kept"] if keep_bytes else []))
