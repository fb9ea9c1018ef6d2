"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its word shingles' 64-bit
hashes have it set. Equal fingerprints are taken together first. Two fingerprints that
differ in at most 4 bits, cut into three segments, have a segment in which they differ
in at most one; so each is indexed by every segment with each bit of it left out in
turn (64 keys), an equality join on those keys finds all pairs, and counting differing
bits verifies them. A key's members never become pairs of rows: inside a task small
groups are compared by shifted columns, large ones by a search that takes linked
members out as it meets them, and a task returns a spanning forest of its links.

``without_copies`` goes by the similarity of sets of shingles instead, which the same method
finds with longer fingerprints and verifies (``near_copies``).

Defined cases: a null or empty text has no shingles and fingerprint 0, and is linked to
its like as any other; a text of fewer words than a shingle is one shingle; rows with
equal ids share a component; null ids are no one's component unless alone with null;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BITS, fingerprints_of, forest, group_links
from .common import WORD, lean, materialize, slices
from .components import components
from .near_copies import near_copies

FIND = re.compile(WORD).findall
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SEED = 42
#: Segments of a fingerprint, so that four differing bits leave one that differs in at most one.
SEGMENTS = 3
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, repeats included."""
    words = [w.encode() for w in FIND(text.translate(LOWER))] if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: max(1, len(words) - width + 1)]
    stops = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row of ``docs``; 64 bits each, as signed longs."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found, waiting, held = [], [], 0
            for text in part.column(1).to_pylist():
                waiting.append(shingle_hashes(text, width))
                held += len(waiting[-1])
                if held > COUNTED:
                    found.append(fingerprints_of(waiting, 1))
                    waiting, held = [], 0
            found.append(fingerprints_of(waiting, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(found)[:, 0].view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def variant_keys(fps: np.ndarray) -> Iterator[np.ndarray]:
    """One key a fingerprint for each bit: its segment without that bit, and which bit."""
    ends = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
    for low, high in zip(ends, ends[1:]):
        value = fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        for bit in range(high - low):
            yield (value & ~np.uint64(1 << bit) | np.uint64(low + bit << 32)).view(np.int64)


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """(a, b) of representatives in distinct (fp, id) that connect all within ``most`` bits."""
    if not 0 <= most < 2 * SEGMENTS - 1:
        raise ValueError(f"{SEGMENTS} segments find fewer than {2 * SEGMENTS - 1} differing bits")
    columns = ["key", "fp", "id"]

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i in range(0, part.num_rows, 2000):
                cut = [c.to_numpy() for c in part.slice(i, 2000).columns]
                keys = np.concatenate([*variant_keys(cut[0].view(np.uint64))])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.tile(c, BITS)) for c in cut)], columns)

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [*batches]
        if not parts:
            return
        keys, fps, ids = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(len(columns)))
        del parts
        order = np.argsort(keys, kind="stable")
        x, y = group_links(keys[order], fps[order, None].view(np.uint64), most)
        ids = ids[order]
        a, b = forest(ids[x], ids[y])
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["a", "b"])

    keyed = distinct.select("fp", "id").mapInArrow(index, ", ".join(f"{c} long" for c in columns))
    return keyed.repartition("key").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for each row of ``docs``: the smallest id that links lead to, itself included."""
    found = materialize(fingerprints(docs, width, id_col, text_col))  # texts are hashed once
    distinct = found.groupBy("fp").agg(F.min("id").alias("id"))
    linked = components(links(distinct.filter("id is not null"), most)).select(F.col("node").alias("head"), "component")
    heads = distinct.withColumnRenamed("id", "head").join(linked, "head", "left")
    return found.join(heads.select("fp", F.coalesce("component", "head").alias("component")), "fp").select("id", "fp", "component")


def near_duplicate_ids(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    out = near_duplicates(docs, width, most)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def without_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest id.

    Near copies have sets of shingles with at least so much Jaccard similarity, which is
    verified for each link. Rows go one by one: of an id with several texts only those that are copies of a
    smaller id, and of the rows of one id and text all but one, that of the smallest hash of all its
    columns but maps. Rows without an id always stay. Columns may have any names.
    """
    as_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own, text = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col)
    rows = docs.select(as_row).select("row", own.alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    near = materialize(near_copies(rows.filter("id is not null").select("id", "t", "text"), lambda text: shingle_hashes(text, width), similarity))
    dropped = near.filter("id <> component").select("id", "t").distinct()
    again = near.groupBy("id", "t").count().filter("count > 1").select("id", "t")
    kept = rows.select("row", "id", "t").join(dropped, ["id", "t"], "left_anti")
    single = kept.join(again, ["id", "t"], "left_anti").select("row")
    hashed = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = kept.join(again, ["id", "t"], "left_semi").groupBy("id", "t").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row")).select("row")
    return single.union(one).select("row.*")
