"""Lookups: by name, and the last point at or before a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_name(probes: DataFrame, entries: DataFrame, on: str = "name") -> DataFrame:
    """Probes with the entry of that name, or nulls and ``found`` false."""
    marked = entries.withColumn("_found", F.lit(True))
    return probes.join(marked, on, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def as_of(probes: DataFrame, points: DataFrame, by: list[str], at: str, value: Column | str, tie: str | None = None, out: str = "nearest", stride: int | None = None) -> DataFrame:
    """Probes with ``value`` of the last point of the same key whose ``at`` is not beyond theirs, or null.

    One union and one window instead of a range join: each key is shuffled
    once and read in order. Of points at the same place the one with the
    largest ``tie`` counts. Null keys match nothing.

    With a ``stride`` (numeric ``at``), a key is cut into stretches of that
    width, so that one key with most of the rows spreads over many tasks; what
    a stretch inherits from those before it is found over one row a stretch.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [F.col(k) for k in by]
    stretch = F.floor(F.col(at) / stride).cast("long") if stride else F.lit(0).cast("long")
    order = F.col(tie) if tie else F.lit(0)
    columns = [F.col(c) for c in probes.columns]
    p = points.select(*keys, F.col(at), stretch.alias("_s"), F.struct(value.alias("v")).alias("_v"), order.alias("_tie"), F.lit(0).alias("_kind"), F.lit(None).alias("_row"))
    q = probes.select(*keys, F.col(at), stretch.alias("_s"), F.lit(None).alias("_v"), F.lit(None).alias("_tie"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"))
    both = p.unionByName(q)
    w = Window.partitionBy(*by, "_s").orderBy(at, "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    if stride:
        per = both.groupBy(*by, "_s").agg(F.max_by("_v", F.when(F.col("_kind") == 0, F.struct(at, "_tie"))).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        carried = per.select(*by, "_s", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        found = found.join(carried, [*by, "_s"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select("_row.*", F.when(known, F.col("_last.v")).alias(out))


def overlapping(writes: DataFrame, pages: DataFrame, by: list[str], page_size: int) -> DataFrame:
    """Each write with each page it touches: (start, end) of the overlap, in the page and in the write.

    A write names the pages it touches, so this is an equi-join on the page
    number and not a join on ranges. ``writes`` has offset and length,
    ``pages`` has page_index.
    """
    from quireflow.functions.geometry import touched

    each = writes.withColumn("page_index", F.explode(touched("offset", "length", page_size)))
    start = F.col("page_index") * page_size
    lo, hi = F.greatest(F.col("offset"), start), F.least(F.col("offset") + F.col("length"), start + page_size)
    return each.join(pages, [*by, "page_index"]).withColumns({"in_page": lo - start, "in_write": lo - F.col("offset"), "n": hi - lo})
