"""SimHash fingerprints of shingle hashes, and links between those that lie near each other."""

from __future__ import annotations

import numpy as np

BITS = 64
#: Most hashes whose bits are added up in the bytes of a word.
BLOCK = 255
#: Members of a key up to which they are compared by shifted columns.
SMALL = 32


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits from each hash (the finaliser of SplitMix64)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each of consecutive lists of hashes the bits that over half of them have; lists may be empty.

    Every eighth bit of a hash is added up in a byte of its own, eight bits at a time.
    """
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not full.size:
        return out
    n = lengths[full]
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(n) - n, blocks) + place * BLOCK
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat(values >> np.uint64(k) & ones, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > n[:, None]).astype(np.uint64)
        for byte in range(8):  # the lowest first, as words are little-endian
            out[full] |= over[:, byte] << np.uint64(8 * byte + k)
    return out


def fingerprints_of(lists: list[np.ndarray], tables: int) -> np.ndarray:
    """Fingerprints by (list, table) of lists of hashes."""
    values = np.concatenate([np.zeros(0, np.uint64), *lists])
    lengths = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), tables), np.uint64)
    for t in range(tables):
        out[:, t] = majority(values, lengths)
        if t + 1 < tables:
            values = remixed(values)
    return out


def close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which rows of (fingerprint, table) differ in at most so many bits."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most


def group_links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked members, which connect all that are linked inside a key; keys sorted."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for i, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        left = np.arange(i, i + n)
        while left.size:
            front, left = left[:1], left[1:]
            # A level of the search at a time, member by member of the smaller side.
            while front.size and left.size:
                new = []
                if front.size <= left.size:
                    for at in front.tolist():
                        near = close(fps[left], fps[at], most)
                        met = left[near]
                        a.append(np.full(met.size, at))
                        b.append(met)
                        new.append(met)
                        left = left[~near]
                        if not left.size:
                            break
                else:
                    hit = np.zeros(left.size, bool)
                    for j, at in enumerate(left.tolist()):
                        near = np.flatnonzero(close(fps[front], fps[at], most))
                        if near.size:
                            hit[j] = True
                            a.append(front[near[:1]])
                            b.append(left[j : j + 1])
                    new.append(left[hit])
                    left = left[~hit]
                front = np.concatenate(new)
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for d in range(1, SMALL):
        small = small[small + d < len(keys)]
        small = small[keys[small] == keys[small + d]]
        if not small.size:
            break
        met = small[close(fps[small], fps[small + d], most)]
        a.append(met)
        b.append(met + d)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between equal nodes' components only once: each node's and its smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    hung = root != np.arange(len(nodes))
    return nodes[hung], nodes[root[hung]]
