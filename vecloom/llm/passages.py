"""Passages that texts share: which windows of a text may occur elsewhere, and their contexts.

A text is a sequence of units (bytes or words), a window ``size`` consecutive ones. Of
the k-grams in a window the one with the smallest hash, the leftmost of equals, is its
anchor. Equal windows have equal anchors at equal offsets, and neighbouring windows
mostly share theirs, so a text has far fewer anchors than windows.

1. ``shared`` finds the anchors whose hash occurs in more than one place. A task sends
   each hash once for each slice of texts, however often the slice has it.
2. ``contexts`` cuts out of the texts what the windows of each such anchor cover and
   deals it by anchor. A resolver first compares those of a slice, whose spans go back
   directly; of equal contexts in a slice one is then sent.
3. The same resolver compares the contexts of an anchor from all slices.
What tasks send each other is packed, a row for each slice and receiving task.

Texts are shuffled once, by key; the plan's uses of them share that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import lean, materialize, slices, small_batches

#: UTF-8 bytes of text whose units are hashed at once.
SLICE = 1 << 20
#: A hash that fewer slices have is never frequent.
LEAST_HOT = 200
BASE = 0x9E3779B97F4A7C15
MIXER = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 to n - 1, modulo 2**64."""
    return _powers(1 << max(12, (n - 1).bit_length()), pow(BASE, -1, 1 << 64) if inverse else BASE)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIXER
    return x ^ (x >> np.uint64(29))


class Texts:
    """UTF-8 bytes of a slice of texts, and where each begins and ends; null is empty."""

    def __init__(self, column: pa.Array) -> None:
        column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]


class Bytes:
    """A slice's bytes as units."""

    def __init__(self, texts: Texts) -> None:
        self.bounds, self.data = texts.bounds, texts.bytes
        self.starts = self.ends = None

    def hashes(self) -> np.ndarray:
        return self.data.astype(np.uint64) + np.uint64(1)

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(first.tolist(), last.tolist())]


class Words:
    """A slice's words as units, with one space between those of a text."""

    def __init__(self, texts: Texts) -> None:
        raw = texts.bytes
        inner = (raw != 32) & ((raw < 9) | (raw > 13))
        # A word starts at an inner byte after white space or at a text's start.
        edge = np.zeros(len(raw) + 1, bool)
        edge[texts.bounds] = True
        starts = inner & np.r_[True, ~inner[:-1]][: len(raw)] | inner & edge[:-1]
        stops = inner & (np.r_[~inner[1:], True][: len(raw)] | edge[1:])
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, texts.bounds)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        sums = np.r_[np.uint64(0), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers(len(self.raw)), dtype=np.uint64)]
        return mixed((sums[self.ends] - sums[self.starts]) * powers(len(self.raw) + 1, True)[self.starts])

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with a space behind each, and where they start and end there."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        starts = ends - lengths
        inner = np.ones(len(out), bool)
        inner[ends] = False
        source = np.arange(len(out)) + np.repeat(self.starts - starts, lengths + 1)
        out[inner] = self.raw[source[inner]]
        return out.tobytes(), starts, ends

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        data, starts, ends = self.spaced()
        return [data[a:b] for a, b in zip(starts[first].tolist(), ends[last - 1].tolist())]


class Anchors:
    """Anchors of all windows in a slice: place, hash, and first and last window of each."""

    def __init__(self, units: Bytes | Words, size: int, gram: int) -> None:
        u, bounds = units.hashes(), units.bounds
        n = len(u)
        empty = np.zeros(0, np.int64)
        self.place = self.first = self.last = self.text = empty
        self.hash = np.zeros(0, np.uint64)
        if n < size:
            return
        sums = np.r_[np.uint64(0), np.cumsum(u * powers(n), dtype=np.uint64)]
        grams = mixed((sums[gram:] - sums[:-gram]) * powers(n + 1, True)[: n + 1 - gram])
        low = np.uint64((1 << n.bit_length()) - 1)
        least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
        # The smallest of each window's k-grams, by doubling spans.
        span, width = 1, size - gram + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        place = (least & low).astype(np.int64)
        begin = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
        windows = np.flatnonzero(np.arange(len(place)) + size <= bounds[1:][begin])
        if not windows.size:
            return
        at = place[windows]
        new = np.r_[True, (at[1:] != at[:-1]) | (np.diff(begin[windows]) != 0)]
        starts = np.flatnonzero(new)
        self.first, self.last = windows[starts], windows[np.r_[starts[1:], len(windows)] - 1]
        self.place, self.text = at[starts], begin[windows[starts]]
        self.hash = grams[self.place]


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(key, id, text) and, if given, rest: key is the id where each has one text only and none is null, else a hash of both."""
    by_id = docs.groupBy(F.col(id_col).alias("i")).agg((F.min(F.xxhash64(text_col)) != F.max(F.xxhash64(text_col))).alias("d"), F.count(F.lit(1)).alias("n"), F.count(text_col).alias("t"))
    several = by_id.filter("d or (n <> t and t > 0) or i is null").limit(1).count() > 0
    small_batches(docs.sparkSession)
    key = F.xxhash64(id_col, text_col) if several else F.col(id_col).cast("long")
    return docs.select(key.alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias("rest") for c in more))


def pack(columns: list[np.ndarray]) -> bytes:
    """Arrays in few bytes: their bytes by significance, compressed."""
    sizes = np.array([len(columns), *(x for c in columns for x in (c.dtype.itemsize, len(c)))], "<i8")
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    raw = sizes.tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    sizes = np.frombuffer(raw, "<i8", 1 + 2 * len(kinds))[1:].tolist()
    at, out = 8 * (1 + 2 * len(kinds)), []
    for kind, width, n in zip(kinds, sizes[::2], sizes[1::2]):
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += width * n
    return out


PACKED = "bucket int, kind int, packed binary"


def packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "packed"])


def dealt(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A packed row for each bucket."""
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1], True]) if by.size else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[by[i]]), kind, pack([c[by[i:j]] for c in columns])


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(values.view(np.uint64)) >> np.uint64(20)) % np.uint64(buckets)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_key(sent: DataFrame, names: list[str], kinds: list) -> DataFrame:
    """(key, names): packed rows of (key, values) as one row for each key, its values as bytes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, ["<i8", *kinds]) for batch in batches for x in batch.column(2).to_pylist()]
        if not parts:
            return
        keys, *columns = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(keys, kind="stable")
        keys, columns = keys[order], [c[order] for c in columns]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for i in range(0, len(edges) - 1, 20_000):
            cut = edges[i : i + 20_001].tolist()
            values = [pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut[:-1]]), *values], ["key", *names])

    return sent.repartitionById(partitions(sent), "bucket").mapInArrow(run, "key long" + "".join(f", {n} binary" for n in names))


FOUND, FOUND_KINDS = ["place", "before", "after"], ["<u4", np.uint8, np.uint8]


def hot_from(rows: DataFrame) -> int:
    """In how many slices a hash is frequent: in one of a hundred, so that all tasks can be told the frequent ones."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_HOT, size // SLICE // 100)


def shared(rows: DataFrame, unit: type, size: int, gram: int, frequent: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(key, FOUND), anchors with a hash that occurs more than once; and the hashes that ``frequent`` slices or more have.

    place: where the anchor is; before, after: from its first and its last window to it.
    A slice has at most SLICE hashes, so where frequent is a share of the slices, the
    frequent hashes are at most SLICE times its inverse.
    """
    buckets = partitions(rows)
    OPEN, KNOWN, SIGN = range(3)
    kinds = ["<i8", "<u8", *FOUND_KINDS]

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            units = unit(Texts(part.column(1)))
            a = Anchors(units, size, gram)
            if not a.hash.size:
                continue
            keys = part.column(0).to_numpy()[a.text]
            columns = [(a.place - units.bounds[a.text]).astype("<u4"), (a.place - a.first).astype(np.uint8), (a.place - a.last).astype(np.uint8)]
            order = np.argsort(a.hash, kind="stable")
            hashes = a.hash[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]]
            count = np.diff(np.r_[np.flatnonzero(new), len(new)])
            repeated = np.repeat(count > 1, count)
            # In the order of texts, which packs well.
            once, twice = np.sort(order[~repeated]), np.sort(order[repeated])
            bucket = bucket_of(a.hash, buckets)
            out = [*dealt(bucket[once], OPEN, [c[once] for c in (keys, a.hash, *columns)])]
            if twice.size:
                # Shared already, and dealt by text, so that a frequent hash doesn't gather
                # them; the hash goes out once more, as a sign for the other slices.
                out += dealt(bucket_of(keys[twice], buckets), KNOWN, [c[twice] for c in (keys, *columns)])
                signs = order[new & repeated]
                out += dealt(bucket[signs], SIGN, [a.hash[signs]])
            yield packed_rows(out)

    @lean
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, signs, known = [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == OPEN:
                    pending.append(unpack(blob, kinds))
                elif kind == SIGN:
                    signs += unpack(blob, ["<u8"])
                else:
                    known.append(unpack(blob, ["<i8", *FOUND_KINDS]))
        found = []
        if pending:
            keys, own, *columns = (np.concatenate(c) for c in zip(*pending))
            hashes = np.concatenate([own, *signs])
            order = np.argsort(hashes, kind="stable")
            sorted_ = hashes[order]
            twin = np.zeros(len(order), bool)
            twin[1:] = sorted_[1:] == sorted_[:-1]
            twin[:-1] |= twin[1:]
            if frequent:
                starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
                hot = sorted_[starts[np.diff(np.r_[starts, len(sorted_)]) >= frequent]]
                if hot.size:
                    yield packed_rows([(0, 1, pack([hot]))])
            at = np.sort(order[twin])
            at = at[at < len(own)]
            found.append([keys[at], *(c[at] for c in columns)])
        found += known
        if found:
            keys, *columns = (np.concatenate(c) for c in zip(*found))
            if len(keys):
                yield packed_rows([*dealt(bucket_of(keys, buckets), 0, [keys, *columns])])

    agreed = rows.select("key", "text").mapInArrow(find, PACKED).repartitionById(buckets, "bucket").mapInArrow(agree, PACKED)
    hot = np.zeros(0, np.uint64)
    if frequent:
        agreed = materialize(agreed)
        found = [unpack(bytes(r["packed"]), ["<u8"])[0] for r in agreed.filter("kind = 1").collect()]
        hot = np.sort(np.concatenate([hot, *found]))
    return by_key(agreed.filter("kind = 0"), FOUND, FOUND_KINDS), hot


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, text, ..., found): rows with a struct of what was found for their key, or null."""
    values = [c for c in found.columns if c != "key"]
    return rows.join(found.select("key", F.struct(*values).alias("found")), "key", "left")


def arrays(column: pa.Array, kinds: list) -> list[list[np.ndarray] | None]:
    """For each row None, or the values under each name of its struct."""
    return [[np.frombuffer(x, k) for x, k in zip(row.values(), kinds)] if row else None for row in column.to_pylist()]


#: Of a context: its route (of its anchor), from its first and its last window to the anchor,
#: key and id, whether that is null, how many windows' starts and bytes it has.
CONTEXT_KINDS = ["<u8", "<i4", "<i4", "<i8", "<i8", np.uint8, "<i4", "<i4"]
SPANS, SPAN_KINDS = ["starts", "stops"], ["<u4", "<u4"]


def contexts(rows: DataFrame, found: DataFrame, unit: type, size: int, gram: int, resolve: Callable, sent_of: Callable, hot: np.ndarray) -> DataFrame:
    """PACKED contexts of shared anchors by route, and spans that are decided already by key.

    Windows of the anchors with the hashes ``hot`` become contexts of their own, each
    with its own route, so that only equal windows meet and a frequent anchor gathers nothing.

    ``resolve`` (see ``resolved``) goes over the slice. sent_of(ids, members) of the equal contexts in a slice
    says which of them still need what other slices have; the others are spans already. Where
    none does one stands for all, without starts of its own.
    """
    buckets = partitions(rows)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = arrays(part.column(3), FOUND_KINDS)
            if not any(found):
                continue
            units = unit(Texts(part.column(2)))
            none = part.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids = part.column(1).fill_null(0).to_numpy()
            keys = part.column(0).to_numpy()
            rows, place, before, after = [], [], [], []
            for i, f in enumerate(found):
                if f:
                    p, index = np.unique(f[0], return_index=True)
                    rows.append(np.full(len(p), i))
                    place.append(p.astype(np.int64) + units.bounds[i])
                    before.append(f[1][index].astype(np.int64))
                    after.append(f[2][index].astype(np.int64))
            row, at, b, a = map(np.concatenate, (rows, place, before, after))
            alone = np.zeros(len(at), bool)
            if frequent.value.size:
                anchors = Anchors(units, size, gram)
                alone = np.isin(anchors.hash[np.searchsorted(anchors.place, at)], frequent.value)
                times = np.where(alone, b - a + 1, 1)
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                row, at, b, a, alone = (np.repeat(c, times) for c in (row, at, b, a, alone))
                b = b - np.where(alone, step, 0)
                a = np.where(alone, b, a)
            texts = units.cut(at - b, at - a + size)
            grams = units.cut(np.where(alone, at - b, at), np.where(alone, at - b + size, at + gram))
            routes = [xxhash.xxh3_64_intdigest(t) for t in grams]
            groups: dict[bytes, list[int]] = {}
            for i, t in enumerate(texts):
                groups.setdefault(t, []).append(i)
            begin = at - b - units.bounds[row]
            every = np.array(routes, "<u8")
            by_route = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.r_[True, every[by_route][1:] != every[by_route][:-1]])
            several = np.diff(np.r_[first, len(every)])
            own = by_route[np.repeat(several > 1, several)]
            decided = []
            if own.size:
                for m, low, high in resolve(every[own], [texts[i] for i in own.tolist()], b[own], a[own], ids[row[own]], none[row[own]]):
                    m = own[m]
                    decided.append((keys[row[m]], begin[m] + low, begin[m] + high))
            ids_of, row_of, start_of = [*zip(none[row].tolist(), ids[row].tolist())], row.tolist(), begin.tolist()
            members_of, starts, counts = [], [], []
            for members in groups.values():
                sent = sent_of([ids_of[i] for i in members], members) if len(members) > 1 else members
                if not sent:
                    members_of.append(members[0])
                    counts.append(0)
                by: dict[int, list[int]] = {}
                for i in sent:
                    by.setdefault(row_of[i], []).append(i)
                for own in by.values():
                    members_of.append(own[0])
                    counts.append(len(own))
                    starts += [start_of[i] for i in own]
            m, n = np.array(members_of, np.int64), np.array(counts, np.int64)
            route = np.array([routes[i] for i in members_of], "<u8")
            lengths = np.array([len(texts[i]) for i in members_of], "<i4")
            fixed = [route, b[m].astype("<i4"), a[m].astype("<i4"), keys[row[m]], ids[row[m]], none[row[m]], n.astype("<i4"), lengths]
            first, places = np.cumsum(n) - n, np.array(starts, "<u4")
            bucket = bucket_of(route, buckets)
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, bucket[by_bucket][1:] != bucket[by_bucket][:-1], True]) if m.size else np.zeros(1, np.int64)
            out = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = by_bucket[i:j]
                step = np.arange(int(n[own].sum())) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                data = np.frombuffer(b"".join([texts[k] for k in m[own].tolist()]), np.uint8)
                out.append((int(bucket[own[0]]), 0, pack([*(c[own] for c in fixed), places[np.repeat(first[own], n[own]) + step], data])))
            if decided:
                to, low, high = (np.concatenate(c) for c in zip(*decided))
                out += dealt(bucket_of(to, buckets), 1, [to, low.astype("<u4"), high.astype("<u4")])
            yield packed_rows(out)

    frequent = rows.sparkSession.sparkContext.broadcast(hot)
    joined = with_found(rows, found).select("key", F.col("id").cast("long").alias("id"), "text", "found")
    return joined.mapInArrow(cut, PACKED)


def resolved(sent: DataFrame, resolve: Callable) -> DataFrame:
    """(key, SPANS): spans decided before, and those that resolve makes of the contexts of each route.

    resolve(routes, contexts, anchors, nearests, ids, none) gets contexts sorted by route
    and yields arrays (context, first, stop): runs of units to remove. none: whose id is null.
    """
    buckets = partitions(sent)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, fixed, places, data = [], [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind:
                    out.append(unpack(blob, ["<i8", *SPAN_KINDS]))
                else:
                    *columns, p, d = unpack(blob, [*CONTEXT_KINDS, "<u4", np.uint8])
                    fixed.append(columns)
                    places.append(p)
                    data.append(d.tobytes())
        if fixed:
            route, anchor, nearest, keys, ids, none, n, lengths = (np.concatenate(c) for c in zip(*fixed))
            place, whole = np.concatenate(places), b"".join(data)
            del fixed, places, data
            n, lengths = n.astype(np.int64), lengths.astype(np.int64)
            first, ends = np.cumsum(n) - n, np.cumsum(lengths)
            order = np.argsort(route, kind="stable")
            texts = [whole[a:b] for a, b in zip((ends - lengths)[order].tolist(), ends[order].tolist())]
            for rows, begin, stop in resolve(route[order], texts, anchor[order].astype(np.int64), nearest[order].astype(np.int64), ids[order], none[order]):
                own = order[rows]
                step = np.arange(int(n[own].sum())) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                at = place[np.repeat(first[own], n[own]) + step]
                out.append([np.repeat(keys[own], n[own]), at + np.repeat(begin, n[own]).astype("<u4"), at + np.repeat(stop, n[own]).astype("<u4")])
        if out:
            keys, starts, stops = (np.concatenate(c) for c in zip(*out))
            if len(keys):
                by = np.lexsort((starts, keys))
                yield packed_rows([*dealt(bucket_of(keys[by], buckets), 0, [keys[by], starts[by].astype("<u4"), stops[by].astype("<u4")])])

    return by_key(sent.repartitionById(buckets, "bucket").mapInArrow(run, PACKED), SPANS, SPAN_KINDS)


def covered(n: int, spans: list[np.ndarray] | None) -> np.ndarray:
    """Which of n units lie in the spans (starts and stops)."""
    if not spans:
        return np.zeros(n, bool)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, spans[0], 1)
    np.add.at(depth, spans[1], -1)
    return np.cumsum(depth[:-1]) > 0


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
