"""Texts whose sets of shingles have at least a Jaccard similarity: SimHash candidates, each link verified exactly.

Rows of equal sets are one node. A node's fingerprint has TABLES times 64 bits, cut into SEGMENTS
segments; candidates have a segment in which they differ in at most one bit (``miss_chance``), that
is, an equal variant of it with one bit left out. Half of such a segment is equal, so a node is dealt once for
each half of each segment, and its variants are made, sorted and joined by equality in the receiving task.
Candidates whose whole fingerprints lie too far apart for the similarity (``bits_apart``) are put aside,
and those whose sizes and parities prove that they can't reach it (``may_fit``), which loses nothing.

A variant's members never become all their pairs at once. First a forest that spans them is
verified against the sets; then, where members are in different components of those links,
all candidates between them are. Either way a pair counts only in the first variant that it shares. So the components are those of all candidates that reach the
similarity, and a large group of near copies takes about as many comparisons as it has members.

Defined cases: sets without shingles equal each other and nothing else; nodes are named by
64-bit hashes of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BITS, close, fingerprints_of, group_links
from .common import lean, materialize, slices, small_batches
from .components import components
from .passages import PACKED, bucket_of, dealt, packed_rows, partitions, unpack

TABLES, SEGMENTS = 5, 16
#: Bits of a segment and of its halves.
WIDTH = BITS * TABLES // SEGMENTS
HALF = WIDTH // 2
#: Standard deviations of the differing bits that candidates may have above what the similarity makes expect.
ALLOWANCE = 2.5
#: Shingles whose bits are counted at once, nodes that are dealt at once, and links that are sent at once.
COUNTED, DEALT, SENT = 1 << 15, 4000, 100_000
#: Members of a variant up to which their pairs are compared by shifted columns.
SMALL = 32

Shingles = Callable[[str | None], np.ndarray]
FPS = [f"fp{t}" for t in range(TABLES)]
#: Bins of a set's shingles, of which a node has one parity bit each, and their columns.
BINS = 256
ODD = [f"odd{i}" for i in range(BINS // 64)]
WORDS = [*FPS, *ODD]
KINDS = ["<u4", "<i8", "<i8", "<i8", *["<u8"] * len(WORDS)]


def differing(similarity: float) -> float:
    """The share of bits in which texts of a Jaccard similarity are expected to differ, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def miss_chance(similarity: float) -> float:
    """Chance that two sets of a Jaccard similarity are no candidates."""
    p = differing(similarity)
    no_segment = (1 - (1 - p) ** WIDTH - WIDTH * p * (1 - p) ** (WIDTH - 1)) ** SEGMENTS
    return no_segment + 0.5 * math.erfc(ALLOWANCE / math.sqrt(2))


def bits_apart(similarity: float) -> int:
    n, p = BITS * TABLES, differing(similarity)
    return int(n * p + ALLOWANCE * math.sqrt(n * p * (1 - p)))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each bin holds an odd number of a set's hashes, in words of 64 bins."""
    held = np.bincount((own % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").view("<u8")


def may_fit(a: np.ndarray, b: np.ndarray, odd_a: np.ndarray, odd_b: np.ndarray, similarity: float) -> np.ndarray:
    """False only for pairs of sets that can't be that similar, by their sizes and parities.

    Each bin of unlike parity holds an element of one set only, so there are at least as many of those.
    """
    unlike = np.bitwise_count(odd_a ^ odd_b).sum(axis=1, dtype=np.int64)
    # Of a + b elements at most (1 - s) / (1 + s) are in one set only; cross-multiplied, with room for rounding.
    return (np.minimum(a, b) / np.maximum(a, b) >= similarity) & (unlike * (1 + similarity) <= (a + b) * (1 - similarity) + 1e-6)


def _sketches(rows: DataFrame, shingles: Shingles) -> DataFrame:
    """(id, t, node, n, WORDS) of rows (id, t, text)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            nodes, sizes, odd, waiting, held, found = [], [], [], [], 0, []
            for text in part.column(2).to_pylist():
                own = np.unique(shingles(text))
                nodes.append(_node(own))
                sizes.append(len(own))
                odd.append(parities(own))
                waiting.append(own)
                held += len(own)
                if held > COUNTED:
                    found.append(fingerprints_of(waiting, TABLES))
                    waiting, held = [], 0
            found.append(fingerprints_of(waiting, TABLES))
            words = np.concatenate([np.concatenate(found), np.stack(odd)], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in words.T)], ["id", "t", "node", "n", *WORDS])

    return rows.select("id", "t", "text").mapInArrow(run, "id long, t long, node long, n long" + "".join(f", {w} long" for w in WORDS))


def _segments(fps: np.ndarray) -> Iterator[np.ndarray]:
    """The segments of fingerprints by (node, table)."""
    for s in range(SEGMENTS):
        word, shift = divmod(s * WIDTH, BITS)
        value = fps[:, word] >> np.uint64(shift)
        if shift + WIDTH > BITS:
            value = value | fps[:, word + 1] << np.uint64(BITS - shift)
        yield value & np.uint64((1 << WIDTH) - 1)


def _dealt(nodes: DataFrame) -> DataFrame:
    """PACKED rows (node, n, label, WORDS), once for each half of each segment, by that half."""
    buckets = partitions(nodes)

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, DEALT):
                node, n, label, *words = (c.to_numpy() for c in batch.slice(i, DEALT).columns)
                fps = np.stack(words[:TABLES], axis=1).view(np.uint64)
                routes = []
                for s, value in enumerate(_segments(fps)):
                    for half in (0, 1):
                        own = value >> np.uint64(HALF * half) & np.uint64((1 << HALF) - 1)
                        routes.append(own + np.uint64((2 * s + half) << HALF))
                route = np.concatenate(routes)
                times = 2 * SEGMENTS
                columns = [route.astype("<u4"), *(np.tile(c, times) for c in (node, n, label)), *(np.tile(c.view(np.uint64), times) for c in words)]
                yield packed_rows([*dealt(bucket_of(route, buckets), 0, columns)])

    return nodes.select("node", "n", "label", *WORDS).mapInArrow(deal, PACKED).repartitionById(buckets, "bucket")


def _variants(route: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
    """For each bit of the half of a segment that its route doesn't hold: route and half without that bit."""
    segment, half = (route >> np.uint32(HALF + 1)).astype(np.int64), route >> np.uint32(HALF) & np.uint32(1)
    other = np.zeros(len(route), np.uint64)
    for s, value in enumerate(_segments(fps)):
        own = segment == s
        other[own] = value[own] >> np.where(half[own] == 0, np.uint64(HALF), np.uint64(0)) & np.uint64((1 << HALF) - 1)
    for bit in range(HALF):
        yield (route.astype(np.uint64) << np.uint64(HALF) | other & ~np.uint64(1 << bit)).view(np.int64)


def first_shared(unlike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, half of the route and bit of the first variant that pairs share, of the bits in which they differ.

    The segment is -1 where they share none.
    """
    segment = np.full(len(unlike), -1, np.int64)
    odd = np.zeros(len(unlike), np.uint64)
    for s, value in enumerate(_segments(unlike)):
        own = (segment < 0) & (np.bitwise_count(value) <= 1)
        segment[own] = s
        odd[own] = value[own]
    low = odd & np.uint64((1 << HALF) - 1)
    # Equal segments share all variants; with a bit in the lower half the pair meets by the upper one.
    half = (low != 0).astype(np.int64)
    place = np.where(half == 1, low, odd >> np.uint64(HALF))
    return segment, half, np.bitwise_count(np.maximum(place, np.uint64(1)) - np.uint64(1)).astype(np.int64)


def _met(nodes: DataFrame, similarity: float, apart: bool) -> DataFrame:
    """(a, b, fits) of nodes (node, n, label, WORDS) that share a variant and lie near each other, each pair once.

    Forests of those that fit (``may_fit``) and those that don't, or with apart all that fit of different labels.
    A pair counts in the first variant that it shares only. Dropped from a later variant's forest it leaves no gap:
    the first variant's forest has a path between the two, of pairs that count there or in turn in an earlier one.
    """
    most = bits_apart(similarity)

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(blob, KINDS) for batch in batches for blob in batch.column(2).to_pylist()]
        if not parts:
            return
        route, node, n, label, *words = (np.concatenate(c) for c in zip(*parts))
        del parts
        by = np.lexsort((node, route))
        route, node, n, label = route[by], node[by], n[by], label[by]
        fps, odd = (np.stack([w[by] for w in some], axis=1) for some in (words[:TABLES], words[TABLES:]))
        for bit, keys in enumerate(_variants(route, fps)):
            order = np.argsort(keys, kind="stable")
            x, y = _apart(keys[order], fps, label, order, most) if apart else group_links(keys[order], fps[order], most)
            if not apart:
                x, y = order[x], order[y]
            for i in range(0, len(x), SENT):
                u, v = x[i : i + SENT], y[i : i + SENT]
                segment, half, place = first_shared(fps[u] ^ fps[v])
                first = (segment == route[u] >> np.uint32(HALF + 1)) & (half == route[u] >> np.uint32(HALF) & np.uint32(1)) & (place == bit)
                u, v = u[first], v[first]
                fits = may_fit(n[u], n[v], odd[u], odd[v], similarity)
                if apart:
                    u, v, fits = u[fits], v[fits], fits[fits]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[u], node[v])), pa.array(np.maximum(node[u], node[v])), pa.array(fits)], ["a", "b", "fits"])

    return _dealt(nodes).mapInArrow(meet, "a long, b long, fits boolean")


def _apart(keys: np.ndarray, fps: np.ndarray, labels: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (places before the order) that share a key, lie near each other and have different labels; keys sorted."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for i, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = order[i : i + size]
        names, which, counts = np.unique(labels[own], return_inverse=True, return_counts=True)
        # Those outside the largest component against all others, those before them aside.
        few = np.flatnonzero(which != np.argmax(counts)) if len(names) > 1 else ()
        done = np.zeros(size, bool)
        for at in few:
            done[at] = True
            rest = own[(which != which[at]) & ~done]
            near = rest[close(fps[rest], fps[own[at]], most)]
            a.append(np.full(near.size, own[at]))
            b.append(near)
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for d in range(1, SMALL):
        small = small[small + d < len(keys)]
        small = small[keys[small] == keys[small + d]]
        if not small.size:
            break
        x, y = order[small], order[small + d]
        met = labels[x] != labels[y]
        x, y = x[met], y[met]
        near = close(fps[x], fps[y], most)
        a.append(x[near])
        b.append(y[near])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _verified(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, shingles: Shingles, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets are similar; sets are made again from the texts of these nodes only."""

    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [np.unique(shingles(text)) for text in part.column(0).to_pylist()]
            nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "own"])

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            same = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                same.append(common / (len(both) - common) >= similarity)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(distinct.join(nodes, "node", "left_semi").select("t"))
    sets = materialize(rows.join(wanted, "t", "left_semi").select("text").mapInArrow(make, "node long, own binary").dropDuplicates(["node"]))
    # A node with very many pairs is met first, while rows are small.
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def near_copies(rows: DataFrame, shingles: Shingles, similarity: float) -> DataFrame:
    """(id, t, node, component) for each of ``rows`` (id, t, text; ids not null, t a hash of the text): the smallest id that links lead to."""
    small_batches(rows.sparkSession)
    found = materialize(_sketches(rows, shingles))
    firsts = [F.first(c).alias(c) for c in WORDS]  # equal for equal sets
    distinct = materialize(found.groupBy("node").agg(F.min("id").alias("id"), F.min("t").alias("t"), F.min("n").alias("n"), *firsts))
    full = distinct.filter("n > 0")
    forest = materialize(_met(full.withColumn("label", F.col("node")), similarity, apart=False))
    links = _verified(forest.filter("fits").select("a", "b"), rows, distinct, shingles, similarity)
    linked = components(links).select("node", F.col("component").alias("label"))
    # Whoever has a candidate is in the forest, if only by a pair that can't fit; the others need no second look.
    met = forest.select(F.col("a").alias("node")).union(forest.select(F.col("b").alias("node"))).distinct()
    labelled = full.join(met, "node", "left_semi").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = _verified(materialize(_met(labelled, similarity, apart=True).select("a", "b")), rows, distinct, shingles, similarity)
    # The stars found before stand for all links that led to them.
    linked = components(linked.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    named = distinct.select("node", "id").join(linked, "node", "left").select("node", "id", F.coalesce("component", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    heads = materialize(named.join(least, "label").select("node", "component"))
    return found.select("id", "t", "node").join(heads, "node").select("id", "t", "node", "component")
