"""Two-hour chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import CHUNK_SECONDS


def chunk_start(ts: Column) -> Column:
    return ts - ts % CHUNK_SECONDS


def chunk_end(start: Column) -> Column:
    return start + CHUNK_SECONDS


def data_set(prefix: str, start: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), start.cast("string"))


def overlaps(start: Column, first: int, last: int) -> Column:
    """Whether the chunk that begins at ``start`` meets [first, last], ends included on both sides; with literals, this prunes
    partitions by chunk_start. A range that ends before it begins meets a chunk with either end."""
    if first <= last:
        return (start <= last) & (start >= first - CHUNK_SECONDS)
    return ((start <= first) & (start >= first - CHUNK_SECONDS)) | ((start <= last) & (start >= last - CHUNK_SECONDS))
