"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: largest estimated size of a side that is broadcast
BROADCAST_BYTES = 32 << 20
#: what empties the tables that a worker keeps between tasks
_FORGET: list[Callable[[], None]] = []
#: glibc keeps what was freed unless it is asked; other C libraries have no such call
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept_by_worker(forget: Callable[[], None]) -> None:
    _FORGET.append(forget)


def forget_tables() -> None:
    """Empty what stages before this one left in the worker, and give the C library's free memory back."""
    for forget in _FORGET:
        forget()
    if _TRIM:
        _TRIM(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text mod 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def for_learning(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from; a row without an id is neither learned from nor held out."""
    return F.coalesce(fold(doc_id) != 2, F.lit(False))


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast `df` when its counted `rows` are small; else leave the choice to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def sampled(share: Column | float, *keys: str) -> Column:
    """True for a repeatable share of rows, chosen by a hash of `keys`."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that long texts are turned to Python values a few at a time.

    Memory that Arrow keeps for later goes back after each batch, as workers stay on for other stages.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, lengthened until no column of `df` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
