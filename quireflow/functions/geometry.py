"""Page geometry of an entry's uncompressed stream, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_SIZE = 4096
READ_AHEAD = 8
CACHE_BYTES = 16 << 20


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast("long")


def page_count(size, page_size: int = PAGE_SIZE) -> Column:
    """Pages that hold ``size`` bytes; the last may be short, an empty stream has none."""
    return F.floor((_long(size) + (page_size - 1)) / page_size).cast("long")


def page_start(page, page_size: int = PAGE_SIZE) -> Column:
    return _long(page) * page_size


def page_length(size, page, page_size: int = PAGE_SIZE) -> Column:
    """Bytes of one page: full, short at the tail, 0 past the end."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(page_size).cast("long"), _long(size) - page_start(page, page_size)))


def pages(size, page_size: int = PAGE_SIZE) -> Column:
    """The page numbers of a stream as an array; empty for an empty stream (a plain sequence would count down)."""
    n = page_count(size, page_size)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def touched(offset, length, page_size: int = PAGE_SIZE) -> Column:
    """The pages that bytes [offset, offset + length) touch."""
    first, last = F.floor(_long(offset) / page_size).cast("long"), F.floor((_long(offset) + _long(length) - 1) / page_size).cast("long")
    return F.when(_long(length) > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def tail_length(logical, page, page_size: int = PAGE_SIZE) -> Column:
    """Bytes of a full-size page that lie below the logical size."""
    return page_length(logical, page, page_size)


def clamp_tail(data, logical, page, page_size: int = PAGE_SIZE) -> Column:
    """A page's bytes cut at the logical size."""
    data = F.col(data) if isinstance(data, str) else data
    return F.substring(data, F.lit(1), tail_length(logical, page, page_size).cast("int"))


def in_range(offset, length, size) -> Column:
    """Whether [offset, offset + length) lies within ``size`` bytes."""
    return (_long(offset) >= 0) & (_long(length) >= 0) & (_long(offset) + _long(length) <= _long(size))


def read_ahead(target, total_pages, ahead: int = READ_AHEAD) -> Column:
    """The run of pages one miss may decode: the target and up to ``ahead`` after it."""
    return F.sequence(_long(target), F.least(_long(target) + ahead, _long(total_pages) - 1))
