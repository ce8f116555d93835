"""Pages: cutting streams, resolving a page through its tiers, patching and putting streams together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import geometry as G


def split(entries: DataFrame, key: str, data: str, page_size: int = G.PAGE_SIZE) -> DataFrame:
    """(key, page_index, page_start, page_len, data) of each page of each entry; empty entries have none."""
    size = F.octet_length(F.col(data)).cast("long")
    each = entries.select(F.col(key), F.col(data).alias("_d"), size.alias("_n"), F.explode(G.pages(size, page_size)).alias("page_index"))
    start, length = G.page_start("page_index", page_size), G.page_length("_n", F.col("page_index"), page_size)
    return each.select(key, "page_index", start.alias("page_start"), length.cast("int").alias("page_len"), F.substring("_d", (start + 1).cast("int"), length.cast("int")).alias("data"))


def zeros(n: Column) -> Column:
    return F.expr("X''") if n is None else F.rpad(F.lit(b""), n.cast("int"), F.lit(b"\0"))


def resolve_tiers(wanted: DataFrame, dirty: DataFrame, spilled: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """``wanted`` pages with the first tier that has them: 1 (memory), 2 (journal), 3 (source) or 0 (nothing: zeros)."""
    t1, t2, t3 = (t.select(*by, F.col("data").alias(f"_d{i}"), F.lit(True).alias(f"_h{i}")) for i, t in enumerate((dirty, spilled, source), 1))
    out = wanted.join(t1, by, "left").join(t2, by, "left").join(t3, by, "left")
    tier = F.when(F.col("_h1"), 1).when(F.col("_h2"), 2).when(F.col("_h3"), 3).otherwise(0)
    return out.withColumn("tier", tier).withColumn("data", F.coalesce("_d1", "_d2", "_d3")).drop("_d1", "_d2", "_d3", "_h1", "_h2", "_h3")


def full_page(data: Column, page_size: int) -> Column:
    """A page filled up with zeros, as dirty pages are held."""
    return F.rpad(F.coalesce(data, F.lit(b"")), page_size, F.lit(b"\0"))


def patch(page: Column, in_page: Column, piece: Column) -> Column:
    """``page`` with ``piece`` written over it from byte ``in_page``."""
    return F.overlay(page, piece, (in_page + 1).cast("int"), F.octet_length(piece))


def source_page(data: Column, start: Column, source_size: Column, page_size: int) -> Column:
    """A page as the source gives it: nothing above the source's high-water mark, zeros instead."""
    n = F.greatest(F.lit(0).cast("long"), F.least(F.lit(page_size).cast("long"), source_size - start))
    return full_page(F.substring(data, F.lit(1), n.cast("int")), page_size)


def assemble(pages: DataFrame, key: str) -> DataFrame:
    """(key, content): pages side by side in order. One entry is one row, as large as the entry."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "data"))), lambda p: p["data"])
    # hex digits are joined in one step where adding page to page would copy what came before each time
    joined = F.unhex(F.array_join(F.transform(ordered, F.hex), ""))
    return pages.groupBy(key).agg(joined.alias("content"))


def read(entries: DataFrame, reads: DataFrame, key: str, data: str, size: Column | None = None, strict: bool = True) -> DataFrame:
    """``reads`` (key, offset, length) with their bytes and a status.

    A clean entry refuses a read past its end (OutOfRange); a dirty one
    (``strict`` false) gives what there is. Unknown entries are NotFound.
    """
    e = entries.select(F.col(key), F.col(data).alias("_d"), (F.octet_length(F.col(data)) if size is None else size).cast("long").alias("_n"))
    out = reads.join(e, key, "left")
    ok = G.in_range("offset", "length", "_n")
    n = F.greatest(F.lit(0).cast("long"), F.least(F.col("length").cast("long"), F.col("_n") - F.col("offset")))
    status = F.when(F.col("_n").isNull(), "NotFound").when(ok | F.lit(not strict), "Ok").otherwise("OutOfRange")
    bytes_ = F.when(status == "Ok", F.substring("_d", (F.col("offset") + 1).cast("int"), n.cast("int")))
    return out.select(*reads.columns, status.alias("status"), bytes_.alias("bytes"))
