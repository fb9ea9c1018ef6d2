"""Column expressions and numpy kernels on vectors."""

from .distance import DUCKDB_L2SQ, l2sq, norm, normalized, register
from .layout import Layout, human_bytes, mb_to_frames

__all__ = ["DUCKDB_L2SQ", "Layout", "human_bytes", "l2sq", "mb_to_frames", "norm", "normalized", "register"]
