"""The name overlay over an archive's immutable entries: created, removed and renamed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CREATED, TOMBSTONE, ALIASED = "Created", "Tombstone", "Aliased"


def kind(overlay: Column, in_index: Column) -> Column:
    """Absent, Created or Source, from a name's overlay row and whether the index has it."""
    return (
        F.when(overlay == TOMBSTONE, "Absent").when(overlay == CREATED, "Created").when(overlay == ALIASED, "Source").when(in_index, "Source").otherwise("Absent")
    )


def resolve(names: DataFrame, overlay: DataFrame, index: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``names`` with kind, source_name (whose data it has), original size and status.

    An alias reads its source; a created name has no source. Status is
    NotFound, Unsupported (the codec isn't built in) or Ok.
    """
    keys = [*(by or []), "name"]
    o = overlay.select(*keys, F.col("kind").alias("_o"), F.col("source").alias("_source"))
    i = index.select(*(by or []), F.col("name").alias("_target"), F.col("uncompressed_size").alias("_size"), F.col("provider").alias("_provider"))
    own = index.select(*keys, F.lit(True).alias("_in"))
    out = names.join(o, keys, "left").join(own, keys, "left").withColumn("kind", kind(F.col("_o"), F.coalesce("_in", F.lit(False))))
    out = out.withColumn("_target", F.when(F.col("kind") == "Source", F.coalesce("_source", "name"))).join(i, [*(by or []), "_target"], "left")
    status = F.when(F.col("kind") == "Absent", "NotFound").when((F.col("kind") == "Source") & F.col("_provider").isNull(), "NotFound").when(~F.coalesce(F.col("_provider").isin("Store", "Deflate"), F.col("kind") == "Created"), "Unsupported").otherwise("Ok")
    return out.withColumn("status", status).withColumn("original_size", F.when(F.col("kind") == "Created", F.lit(0)).otherwise(F.col("_size")).cast("long")).withColumnRenamed("_target", "source_name").drop("_o", "_source", "_in", "_size", "_provider")


def edited(names: DataFrame, overlay: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``names`` that have a row in the overlay."""
    keys = [*(by or []), "name"]
    return names.join(overlay.select(*keys), keys, "left_semi")


def unedited(names: DataFrame, overlay: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``names`` that have none."""
    keys = [*(by or []), "name"]
    return names.join(overlay.select(*keys), keys, "left_anti")


def effective(index: DataFrame, overlay: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every name that exists: (name, origin, source), origin Kept, Created or Aliased.

    A name created again after its entry was removed is Created; order is not part of the result.
    """
    keys = [*(by or []), "name"]
    kept = unedited(index, overlay, by).select(*keys, F.lit("Kept").alias("origin"), F.col("name").alias("source"))
    created = overlay.where(F.col("kind") == CREATED).select(*keys, F.lit("Created").alias("origin"), F.lit(None).cast("string").alias("source"))
    aliased = overlay.where(F.col("kind") == ALIASED).select(*keys, F.lit("Aliased").alias("origin"), F.col("source"))
    return kept.unionByName(created).unionByName(aliased)


def names_of(overlay: DataFrame, what: str) -> DataFrame:
    """Created names, tombstones, or aliases with their source."""
    rows = overlay.where(F.col("kind") == what)
    return rows.select("name", "source") if what == ALIASED else rows.select("name")


def validate(op: str, exists: Column, target_exists: Column | None = None, supported: Column | None = None) -> Column:
    """The outcome of an entry operation: Ok, NotFound, Exists or Unsupported.

    Removing and renaming work on entries of unknown codecs, truncating doesn't.
    """
    if op == "CREATE":
        return F.when(exists, "Exists").otherwise("Ok")
    out = F.when(~exists, "NotFound")
    if op == "RENAME":
        out = out.when(target_exists, "Exists")
    if op == "RESIZE" and supported is not None:
        out = out.when(~supported, "Unsupported")
    return out.otherwise("Ok")
