"""Byte-level BPE, encoded and decoded as a monoid.

Encoding a match that is no token itself halves it down to LEAF bytes and joins the token
lists on the way up. A join re-encodes a window around the boundary and widens it until both pairs at its edges are
stable: ``(x, y)`` is stable if encoding the bytes of both gives just x and y again. A
list whose neighbours are all stable pairs is the encoding of its bytes: merges run by
rank, so up to the first merge across a boundary the two tokens beside it have gone
through the merges they would go through alone, and alone they never merge. So the
tokens outside the window are final. Matches need no join between them: the pattern cuts
there for good, and a worker remembers the ids of short ones. Decoding halves the ids down
to SPELLED tokens and concatenates bytes up the tree.

Defined cases: a null or empty text has no ids and decodes to no bytes; ids may be null
and may repeat; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: Bytes of a leaf, and those from which on a window's merges are queued.
LEAF, DIRECT = 4, 48
#: Tokens of a leaf when ids are decoded.
SPELLED = 32
#: Most matches, leaves, windows and pairs that a worker remembers, the longest match (characters), and the longest window; beyond it the dictionary starts anew.
REMEMBERED, LONGEST, SHORT = 400_000, 64, 12
#: The rank files' \s: the Unicode property White_Space.
WHITE = r"\t\n\x0b\f\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class ByteBPE:
    """A vocabulary of byte strings by rank, and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.known: dict[str, bytes] = {}
        self.merged: dict[bytes, list[bytes]] = {}
        self.stable_pairs: dict[tuple[bytes, bytes], bool] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[bytes]:
        """Merges by rank, the leftmost of equals first."""
        if len(piece) > DIRECT:
            return self._merge_queued(piece)
        if (known := self.merged.get(piece)) is not None:
            return known
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.token_bytes)
        ranks = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], none)
        if len(piece) <= SHORT:
            if len(self.merged) > REMEMBERED // 2:
                self.merged.clear()
            self.merged[piece] = parts
        return parts

    def _merge_queued(self, piece: bytes) -> list[bytes]:
        """The same with a queue of pairs, for windows that a join can't keep short."""
        n, get = len(piece), self.ranks.get
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        queue = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] is None or j < 0 or get(both := parts[i] + parts[j]) != rank:
                continue  # one of the pair has gone into another merge
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(both + parts[k])) is not None:
                    heapq.heappush(queue, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] + both)) is not None:
                heapq.heappush(queue, (r, h))
        return [x for x in parts if x is not None]

    def stable(self, x: bytes, y: bytes) -> bool:
        found = self.stable_pairs.get((x, y))
        if found is None:
            if len(self.stable_pairs) > REMEMBERED // 2:
                self.stable_pairs.clear()
            found = self.stable_pairs[x, y] = self.merge(x + y) == [x, y]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of both together, from the encodings of each."""
        if self.stable(left[-1], right[0]):
            return left + right
        a = b = 0
        window: list[bytes] = []
        while True:
            # An edge that isn't stable moves outwards; the window between is encoded again.
            grow_left = a < len(left) and not self.stable(left[-1 - a], window[0] if window else right[b])
            grow_right = b < len(right) and not self.stable(window[-1] if window else left[-1 - a], right[b])
            if not grow_left and not grow_right:
                return left[: len(left) - a] + window + right[b:]
            a = min(len(left), 2 * a + 1) if grow_left else a
            b = min(len(right), 2 * b + 1) if grow_right else b
            window = self.merge(b"".join(left[len(left) - a :] + right[:b]))

    def encode_tree(self, piece: bytes) -> list[bytes]:
        """Token bytes of one match."""
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_tree(piece[:half]), self.encode_tree(piece[half:]))

    def encode_match(self, match: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        piece = match.encode()
        tokens = [piece] if piece in self.ranks else self.encode_tree(piece)
        return struct.pack(f"<{len(tokens)}I", *map(self.ranks.__getitem__, tokens))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for match in self.split(text):
            ids = known.get(match)
            if ids is None:
                ids = self.encode_match(match)
                if len(match) <= LONGEST:
                    known[match] = ids
            out.append(ids)
        return b"".join(out)

    def decode_tree(self, ids: list[int]) -> bytes:
        if len(ids) <= SPELLED:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode_tree(ids[:half]) + self.decode_tree(ids[half:])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_tree(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.from_file(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``, and with keep_ids the ids (array<int>)."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches, "text"):
            n, hashes, back, ids = [], [], [], []
            for text in part.column(1).to_pylist():
                encoded = bpe.encode(text)
                n.append(len(encoded) // 4)
                hashes.append(sha(encoded))
                back.append(sha(bpe.decode(encoded)))
                if keep_ids:
                    ids.append(np.frombuffer(encoded, "<i4"))
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, ["id", "n", "h", "d", "ids"][: 4 + keep_ids])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n long, h string, d string" + ", ids array<int>" * keep_ids)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("h").alias("ids_sha256"), F.col("d").alias("decoded_sha256"), *(["ids"] if keep_ids else []))
