"""Arithmetic of a paged inverted file: how many pages vectors, lists and centroids take.

Nothing here is stored so; the figures feed the page-access trace and its cache
simulation, and reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Fixed values of the page format: bytes of a page, of an id, of a value, of a list's extent.
PAGE, ID_BYTES, VALUE_BYTES, EXTENT_BYTES = 4096, 8, 4, 16
#: Fewest frames of a cache.
LEAST_FRAMES = 8


@dataclass(frozen=True)
class Layout:
    """Pages of an index of vectors of ``dim`` values in ``nlist`` lists; page 0 is the header."""

    dim: int
    nlist: int

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("a vector has at least one value")
        if self.entry_bytes > PAGE:
            raise ValueError(f"a record of {self.entry_bytes} bytes doesn't fit a page; {(PAGE - ID_BYTES) // VALUE_BYTES} values do")

    @property
    def vector_bytes(self) -> int:
        return VALUE_BYTES * self.dim

    @property
    def entry_bytes(self) -> int:
        return ID_BYTES + self.vector_bytes

    @property
    def entries_per_page(self) -> int:
        return PAGE // self.entry_bytes

    @property
    def centroids_per_page(self) -> int:
        return PAGE // self.vector_bytes

    @property
    def centroid_pages(self) -> int:
        return -(-self.nlist // self.centroids_per_page)

    @property
    def extents_per_page(self) -> int:
        return PAGE // EXTENT_BYTES

    @property
    def extent_pages(self) -> int:
        return -(-self.nlist // self.extents_per_page)

    @property
    def centroids_start(self) -> int:
        return 1

    @property
    def extents_start(self) -> int:
        return self.centroids_start + self.centroid_pages

    @property
    def lists_start(self) -> int:
        return self.extents_start + self.extent_pages

    def list_pages(self, count: Column) -> Column:
        """Pages of a list of so many entries."""
        return F.ceil(count / F.lit(self.entries_per_page)).cast("long")

    def entry_page(self, start_page: Column, slot: Column) -> Column:
        return start_page + F.floor(slot / F.lit(self.entries_per_page)).cast("long")

    def entry_offset(self, slot: Column) -> Column:
        return slot % self.entries_per_page * self.entry_bytes


def human_bytes(n: float) -> str:
    """Bytes with a binary unit, one digit after the point."""
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"


def mb_to_frames(mib: float) -> int:
    """Frames of a cache of so many MiB."""
    return max(LEAST_FRAMES, int(mib * 1024 * 1024 / PAGE))
