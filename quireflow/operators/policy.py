"""Decisions over one-row summaries: recovery, commit strategy, freshness, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recovery_decision(status: Column, source_changed: Column, empty: Column, last_commit_seq: Column) -> Column:
    """Abort if the journal is unreadable or of another source, discard if empty, recover what is committed, else abort."""
    return F.when((status != "Ok") | source_changed, "Abort").when(empty, "Discard").when(last_commit_seq > 0, "RecoverCommitted").otherwise("Abort")


def bloat_ratio(file_size: Column, live: Column) -> Column:
    return F.when(live == 0, F.lit(1.0)).otherwise(file_size.cast("double") / live)


def should_full(ratio: Column, bloat_bytes: Column, threshold: float = 2.0, most_bytes: int | None = None) -> Column:
    """Rewrite the whole archive once dead space reaches the threshold; no byte limit by default."""
    out = ratio >= threshold
    return out if most_bytes is None else out | (bloat_bytes >= most_bytes)


def commit_mode(dirty: Column, full: Column) -> Column:
    return F.when(~dirty, "Noop").when(full, "Full").otherwise("Incremental")


def fingerprint_verdict(stored_hash: Column, live_hash: Column, same_size: Column, same_inode: Column) -> Column:
    """The directory's hash decides; size and file id only tell Valid from ValidStale; times don't count."""
    return F.when(~stored_hash.eqNullSafe(live_hash), "Invalid").when(same_size & same_inode, "Valid").otherwise("ValidStale")


def source_changed(size: Column, live_size: Column, inode: Column, live_inode: Column, cd_hash: Column, live_hash: Column) -> Column:
    return ~(size.eqNullSafe(live_size) & inode.eqNullSafe(live_inode) & cd_hash.eqNullSafe(live_hash))


def fresh(size: Column, live_size: Column, inode: Column, live_inode: Column, mtime: Column, live_mtime: Column) -> Column:
    """Whether a source is unchanged since it was opened; any difference, and any null, means stale."""
    return F.coalesce((size == live_size) & (inode == live_inode) & (mtime == live_mtime), F.lit(False))


def intent_action(mode: Column, state: Column, prefix_is_pre: Column) -> Column:
    """What to do about an interrupted commit: finish it, go on as before, roll an append back, or leave it."""
    return F.when(state == "post", "DropJournal").when(state == "pre", "Keep").when((mode == "INCREMENTAL") & prefix_is_pre, "Truncate").otherwise("Leave")
