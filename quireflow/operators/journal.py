"""The journal as a table: what is committed, what is live, how large entries are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_commit(journal: DataFrame, by: list[str]) -> DataFrame:
    """The commit sequence of each log's latest marker in file order, 0 if there is none."""
    marker = F.when(F.col("kind") == "COMMIT", F.struct("file_offset", "commit_sequence"))
    return journal.groupBy(*by).agg(F.coalesce(F.max(marker)["commit_sequence"], F.lit(0).cast("long")).alias("last_commit_seq"))


def classify(journal: DataFrame, by: list[str]) -> DataFrame:
    """DATA and META rows with ``committed``: whether a marker covers their sequence."""
    return journal.where(F.col("kind").isin("DATA", "META")).join(last_commit(journal, by), by).withColumn("committed", F.col("sequence") <= F.col("last_commit_seq"))


def live_pages(journal: DataFrame, by: list[str]) -> DataFrame:
    """The latest DATA row of each page, by sequence; map-side combined, no window."""
    data = journal.where(F.col("kind") == "DATA")
    keys = [*by, "entry", "page_index"]
    rest = [c for c in journal.columns if c not in keys]
    newest = data.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("sequence", "file_offset")).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_stamps(journal: DataFrame, by: list[str]) -> DataFrame:
    """When each page first came in; rewriting keeps its stamp."""
    return journal.where(F.col("kind") == "DATA").groupBy(*by, "entry", "page_index").agg(F.min("sequence").alias("stamp"))


def space(journal: DataFrame, by: list[str]) -> DataFrame:
    """records, live, dead and whether compaction pays (more dead than live)."""
    data = journal.where(F.col("kind") == "DATA")
    # distinct pages first: no expand of the data
    per = data.groupBy(*by, "entry", "page_index").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("records"), F.count("*").alias("live"))
    return per.withColumn("dead", F.greatest(F.lit(0).cast("long"), F.col("records") - F.col("live"))).withColumn("should_compact", F.col("dead") > F.col("live"))


def logical_size(base: Column, end_of_pages: Column) -> Column:
    """What recovery takes an entry's size to be: its base, or the end of its farthest page."""
    return F.greatest(base, F.coalesce(end_of_pages, F.lit(0).cast("long")))


def source_high_water(original: Column, smallest_resize: Column) -> Column:
    """How far the source's own bytes still count: shrinking lowers it for good."""
    return F.least(original, F.coalesce(smallest_resize, original))


def spill(journal: DataFrame, by: list[str], resident: int, salts: int = 16) -> DataFrame:
    """Pages with stamp and ``spilled``: the oldest first inserts leave once more than ``resident`` are held.

    A log's newest pages are found in two steps, among the newest of each of
    ``salts`` parts of it, so that no task ranks a whole log; what is older
    than the last of them has spilled. Exact while pages are only written and
    the limit is constant; other histories need the fold in session.replay().
    """
    stamps = first_stamps(journal, by)
    order = [F.desc("stamp"), F.asc("entry"), F.asc("page_index")]
    if not resident:
        return stamps.withColumn("spilled", F.lit(True))
    part = F.pmod(F.xxhash64("entry", "page_index"), F.lit(salts))
    newest = stamps.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))).where(F.col("_r") <= resident)
    edge = newest.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") == resident)
    edge = edge.select(*by, F.struct((-F.col("stamp")).alias("stamp"), "entry", "page_index").alias("_edge"))
    beyond = F.struct((-F.col("stamp")).alias("stamp"), "entry", "page_index") > F.col("_edge")
    return stamps.join(edge, by, "left").withColumn("spilled", F.coalesce(beyond, F.lit(False))).drop("_edge")


def summary(journal: DataFrame, by: list[str]) -> DataFrame:
    """Per log: counts of committed and uncommitted rows, last commit, highest valid sequence."""
    marked = classify(journal, by)
    counts = marked.groupBy(*by).agg(F.count_if("committed").alias("committed"), F.count_if(~F.col("committed")).alias("uncommitted"), F.max("sequence").alias("valid_through_seq"))
    return last_commit(journal, by).join(counts, by, "left").na.fill(0, ["committed", "uncommitted", "valid_through_seq"])
