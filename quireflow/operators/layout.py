"""Where things come to lie: index files and committed archives, as running sums over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions.codes import MAX_32, advisory_size

LOCAL_HEADER, DIRECTORY_RECORD, END_RECORD, INDEX_HEADER, INDEX_RECORD = 30, 46, 22, 128, 96


def _running(rows: DataFrame, by: list[str], order: list[str], stretch: Column, **sums: Column) -> DataFrame:
    """``rows`` with the sums of all rows before each within its key, in order.

    ``stretch`` must rise with the order. Rows are summed up within their
    stretch, and what comes before a stretch is found over one row a stretch,
    so that one key with most of the rows spreads over many tasks.
    """
    rows = rows.withColumn("_stretch", stretch)
    inner = Window.partitionBy(*by, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = rows.groupBy(*by, "_stretch").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    per = per.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate([*by, "_stretch"])], *[F.coalesce(F.sum(f"_{n}").over(before), zero).alias(f"_{n}") for n in sums])
    own = rows.withColumns({n: F.coalesce(F.sum(c).over(inner), zero) for n, c in sums.items()})
    same = [own[c].eqNullSafe(per[f"_by{i}"]) for i, c in enumerate([*by, "_stretch"])]
    return own.join(per, same).select(*[c for c in own.columns if c != "_stretch" and c not in sums], *[(F.col(n) + F.col(f"_{n}")).cast("long").alias(n) for n in sums])


def index_layout(entries: DataFrame, by: list[str], name_hash: Column) -> DataFrame:
    """Entries with their place in the archive's index: number, record offset, offset of the name in the heap.

    Records are in the order of (hash, name); ``name_hash`` must sort as an
    unsigned number (16 hex digits do), and its first digits cut an archive's
    directory into stretches.
    """
    rows = entries.withColumn("name_hash", name_hash)
    rows = _running(rows, by, ["name_hash", "name"], F.substring("name_hash", 1, 3), entry_idx=F.lit(1), name_offset=F.octet_length("name"))
    return rows.withColumn("record_offset", INDEX_HEADER + INDEX_RECORD * F.col("entry_idx"))


def index_size(layout: DataFrame, by: list[str]) -> DataFrame:
    """entry_count, name_heap_size, advisory_offset and checkpoint zone offset of each index."""
    each = layout.groupBy(*by).agg(F.count("*").alias("entry_count"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).cast("long").alias("name_heap_size"))
    start = INDEX_HEADER + INDEX_RECORD * F.col("entry_count") + F.col("name_heap_size")
    return each.withColumn("advisory_offset", start).withColumn("checkpoint_zone", start + advisory_size("entry_count", F.lit(0)))


def commit_layout(effective: DataFrame, by: list[str], order: str, incremental: bool = False, stride: int | None = None) -> DataFrame:
    """Entries of a committed archive with changed, local_header_offset and appended bytes.

    ``effective`` has name, origin (Kept, Created, Aliased), compressed_size,
    modified, and for incremental commits file_size and old_offset. FULL
    places every entry in order; INCREMENTAL leaves unmodified ones where they
    are and appends the others. Offsets that need Zip64 come with ``too_large``.
    With a ``stride`` (numeric ``order``) an archive is laid out in stretches
    of that width, each a task's work.
    """
    changed = F.lit(True) if not incremental else (F.col("origin") != "Kept") | F.coalesce("modified", F.lit(False))
    rows = effective.withColumn("changed", changed)
    bytes_ = F.when(F.col("changed"), LOCAL_HEADER + F.octet_length("name") + F.col("compressed_size")).otherwise(F.lit(0)).cast("long")
    base = F.col("file_size") if incremental else F.lit(0)
    stretch = F.floor(F.col(order) / stride).cast("long") if stride else F.lit(0).cast("long")
    rows = _running(rows.withColumn("appended", bytes_), by, [order], stretch, local_header_offset=F.col("appended"))
    rows = rows.withColumn("local_header_offset", base + F.col("local_header_offset"))
    if incremental:
        rows = rows.withColumn("local_header_offset", F.when(F.col("changed"), F.col("local_header_offset")).otherwise(F.col("old_offset")))
    return rows.withColumn("too_large", F.greatest("local_header_offset", "compressed_size") > MAX_32)


def commit_size(layout: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of entries written and of the new directory with its end record."""
    record = DIRECTORY_RECORD + F.octet_length("name")
    return layout.groupBy(*by).agg(F.sum("appended").alias("body_bytes"), (F.sum(record) + END_RECORD).alias("directory_bytes"), F.count_if("changed").alias("changed"))
