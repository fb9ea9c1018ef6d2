"""numpy kernels: nearest rows of a block, exact to the last bit.

Matrix products give all distances of a block fast but with rounding errors. They only
choose candidates, within a bound on that error; the candidates' distances are then
accumulated value by value like ``distance.l2sq``, and decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Distances that one block holds at most.
BLOCK = 1 << 21


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors of an Arrow list column as rows of float32."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    n = len(column)
    if n and (len(flat) % n or dim is not None and len(flat) != n * dim):
        raise ValueError("vectors differ in length")
    return flat.reshape(n, -1 if n else (dim or 0))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, accumulated in doubles from the first value on."""
    out = np.zeros(len(a))
    for x, y in zip(a.T.astype(np.float64), b.T.astype(np.float64)):
        d = x - y
        out += d * d
    return out


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of each query, ties to smaller ids; in order."""
    k = min(k, len(rows))
    if not k or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    x = rows.astype(np.float64)
    size = np.einsum("ij,ij->i", x, x)
    step = max(1, BLOCK // len(rows))
    for start in range(0, len(queries), step):
        q = queries[start : start + step].astype(np.float64)
        own = np.einsum("ij,ij->i", q, q)
        rough = own[:, None] + size - 2 * (q @ x.T)
        error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(own.max()) + np.sqrt(size.max())) ** 2
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * error
        i, j = np.nonzero(rough <= bound[:, None])
        distance = exact(q[i], x[j])
        order = np.lexsort((ids[j], distance, i))
        i, j, distance = i[order], j[order], distance[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        found.append((i[keep] + start, ids[j[keep]], distance[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def best(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among candidates, in order."""
    order = np.lexsort((ids, distance, query))
    query, ids, distance = query[order], ids[order], distance[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], distance[keep]
