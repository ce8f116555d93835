"""Near-duplicate documents by MinHash with tensored banding.

A document's minhashes form ``collections`` small collections of
``per_collection`` values. A table's key combines two collections, so a few
minhashes give collections * (collections - 1) / 2 tables, whose number alone
sets the recall: a link is missed only if at most one collection agrees
(at similarity 0.8 with 14 collections of 2, about 2 in 100,000).

Texts with equal shingle sets are one class from the start. The smallest class
of a table's bucket is its head. Each class is compared with the smallest of
its heads and the others of that head, on full shingle sets, in blocks of
bounded size by matrix products, so neither a bucket nor a group of copies is
expanded into pairs. Components come from links found so and from nothing
else: candidates that are not alike join nothing. What is then left are
buckets whose members are in several components and have not all met; the
members of such buckets with one head are compared block against block as far
as they are not in one component. That is exact: no two classes that share a
bucket and end in different components remain uncompared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import words as W
from quireflow.llm.graph import connected_components
from quireflow.llm.scratch import Scratch

#: Classes of a block when a head and its members are first compared, and when what is left of a large group is.
BLOCK, WIDE = 64, 256


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): each document's distinct shingles of ``width`` lower-cased words, sorted.

    A document of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    s, e, first = W.bounds(data, offs)
    h = W.word_hashes(data, s, e, lower=True)
    counts = np.diff(first)
    docs = len(counts)
    at = W.starts_within(first, width)
    doc = np.repeat(np.arange(docs), np.maximum(counts - width + 1, 0))
    value = W.rolling(h, width)[at] if len(at) else np.zeros(0, np.uint64)
    for n in range(1, width):  # short ones, by length
        short = np.flatnonzero(counts == n)
        if len(short):
            doc = np.concatenate((doc, short))
            value = np.concatenate((value, W.mix(W.rolling(h, n)[first[short]] + np.uint64(n))))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(docs + 1))


def _digest(value: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    n = np.diff(cut).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(W.mix(value ^ np.uint64(salt)), out=total[1:])
            out.append(W.signed(W.mix(total[cut[1:]] - total[cut[:-1]] + n)))
    return out[0], out[1]


def _signatures(width: int, collections: int, per: int):
    """(doc_id, text) -> doc_id, n_shingles, d1, d2, values (one a collection)."""
    salts = W.mix(np.arange(1, collections * per + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in batches:
            for lo, hi in W.slices(batch.column(1)):
                value, cut = shingle_sets(*W.utf8(batch.column(1).slice(lo, hi - lo)), width)
                d1, d2 = _digest(value, cut)
                full = np.flatnonzero(np.diff(cut))
                keys = np.zeros((hi - lo, collections), np.int64)
                with np.errstate(over="ignore"):
                    for c in range(collections if len(full) else 0):
                        key = np.full(len(full), c, np.uint64)
                        for r in range(per):
                            x = (value ^ salts[c * per + r]) * np.uint64(0xFF51AFD7ED558CCD)
                            x ^= x >> np.uint64(32)
                            x *= np.uint64(0xC4CEB9FE1A85EC53)
                            key = W.mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(x, cut[full]))
                        keys[full, c] = W.signed(key)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cut).astype(np.int64)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * collections, collections, dtype=np.int32)), pa.array(keys.ravel()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "values"],
                )

    return run


def _sets(width: int):
    """(rep, text, d1, d2, grp, blk, blocks) -> rep, grp, blk, blocks, shingles: only rows whose set is the wanted one."""

    def run(batches):
        for batch in batches:
            for lo, hi in W.slices(batch.column(1)):
                value, cut = shingle_sets(*W.utf8(batch.column(1).slice(lo, hi - lo)), width)
                d1, d2 = _digest(value, cut)
                want = [batch.column(i).slice(lo, hi - lo).to_numpy() for i in (2, 3)]
                sets = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(W.signed(value)))
                kept = [batch.column(i).slice(lo, hi - lo) for i in (0, 4, 5, 6)]
                out = pa.RecordBatch.from_arrays([*kept, sets], names=["rep", "grp", "blk", "blocks", "shingles"])
                yield out.filter(pa.array((d1 == want[0]) & (d2 == want[1])))

    return run


def block_links(ids: np.ndarray, sets: pa.ListArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among one block's sets: 100 * intersection >= percent * union, counted exactly."""
    n = len(ids)
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, column = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    both = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, (1 << 21) // n))
    for a in range(0, columns, width):
        i, j = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        both += part @ part.T  # at most ``width`` ones a cell: exact
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(n)
    while True:  # each takes the least label it is linked with
        now = np.where(linked, label[None, :], n).min(axis=1)
        now = np.minimum(now, label)
        now = now[now]
        if (now == label).all():
            break
        label = now
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    root = least[label]
    keep = root != ids
    return ids[keep], root[keep]


def _compare(percent: int):
    """Batches sorted by (k1, k2) of (k1, k2, rep, shingles) -> links (a, b) within each (k1, k2)."""

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        k1, k2, rep = (t.column(i).to_numpy() for i in range(3))
        sets = t.column(3).combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        cuts = [0, *(np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1).tolist(), len(k1)]
        a, b = [], []
        for i, j in zip(cuts, cuts[1:]):
            if j - i > 1:
                x, y = block_links(rep[i:j], sets.slice(i, j - i), percent)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches):
        held, key, bulk = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and key != (k1[0], k2[0]):
                yield from flush(held)
                held = []
            last = (k1[-1], k2[-1])
            cut = int(np.flatnonzero((k1 != last[0]) | (k2 != last[1])).max(initial=-1)) + 1
            if cut:
                yield from flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
            key = last
        if held:
            yield from flush(held)

    return run


def _links(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (k1, k2, rep, shingles), each (k1, k2) of bounded size -> links (a, b)."""
    dealt = members.select("k1", "k2", "rep", "shingles").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def components(docs: DataFrame, width: int = 4, percent: int = 80, collections: int = 14, per_collection: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Links join documents with 100 * |intersection| >= percent * |union| of
    their shingle sets; component_id is the smallest doc_id reachable, itself
    included. Null, empty and wordless texts have an empty set and link with
    nothing. A null doc_id links with nothing and has a null component. Rows
    that repeat a doc_id are one node with the links of all of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash", docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(text.mapInArrow(_signatures(width, collections, per_collection), "doc_id long, n_shingles long, d1 long, d2 long, values array<long>"))

    # classes of equal sets, named by their smallest document
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.keep(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("values").alias("values")))

    # collections on which a class agrees with another; two such make a table key
    single = classes.select("rep", "d1", "d2", F.posexplode("values").alias("j", "v"))
    # (counts are written before they are joined: only a join of two exchanges can be split at a hot key)
    met = scratch.keep(single.groupBy("j", "v").agg(F.count("*").alias("c")).where("c > 1").select("j", "v"))
    agreeing = single.join(met, ["j", "v"], "left_semi").groupBy("rep", "d1", "d2").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("at")).where("size(at) > 1")
    pairs = F.flatten(F.transform("at", lambda x: F.transform(F.filter("at", lambda y: y["j"] > x["j"]), lambda y: F.xxhash64(x["j"], x["v"], y["j"], y["v"]))))
    keyed = scratch.keep(agreeing.select("rep", F.explode(pairs).alias("key")))
    heads = scratch.keep(keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b < z").select("key", "b"))
    tables = scratch.keep(keyed.join(heads, "key"))
    scratch.drop(met, keyed, heads)

    # each class and the smallest head it meets: blocks of up to BLOCK classes whole, larger ones by hash, the head in each
    near = scratch.keep(tables.groupBy("rep").agg(F.min("b").alias("h")))
    n = F.count("*")
    sizes = scratch.keep(near.where("h < rep").groupBy("h").agg(n.alias("n"), F.when(n < BLOCK, F.lit(1)).otherwise(F.ceil(n / (BLOCK // 2))).cast("long").alias("blocks")))
    own = sizes.select(F.col("h").alias("rep"), "blocks")
    placed = near.where("h < rep").join(sizes, "h").select("rep", F.col("h").alias("grp"), F.pmod(F.xxhash64("rep"), "blocks").alias("blk"))
    placed = near.select("rep").join(placed, "rep", "left").join(own, "rep", "left")
    wanted = classes.select("rep", "d1", "d2").join(placed, "rep").withColumnRenamed("rep", "doc_id")
    sets = text.join(wanted, "doc_id").select(F.col("doc_id").alias("rep"), "text", "d1", "d2", "grp", "blk", "blocks")
    # rows that repeat id and text give their set once each; two classes can share a rep only if rows repeat an id
    member = scratch.keep(sets.mapInArrow(_sets(width), "rep long, grp long, blk long, blocks long, shingles array<long>"))
    met_heads = member.where("blocks IS NOT NULL").select(F.col("rep").alias("k1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k2"), "rep", "shingles")
    dealt = member.where("grp IS NOT NULL").select(F.col("grp").alias("k1"), F.col("blk").alias("k2"), "rep", "shingles").union(met_heads)
    links = scratch.keep(_links(dealt, percent))
    found = connected_components(links, scratch)

    # buckets whose members are still apart and were not all in one block
    labels = near.join(found, F.col("rep") == F.col("node"), "left").select("rep", "h", F.coalesce("component", "rep").alias("comp"))
    each = tables.join(scratch.keep(labels), "rep")
    apart = each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("b").alias("b"), F.bool_and((F.col("h") == F.col("b")) | (F.col("rep") == F.col("b"))).alias("same")).where("lo < hi")
    whole = sizes.where("blocks = 1").select(F.col("h").alias("b"), F.lit(True).alias("met"))
    apart = scratch.keep(apart.join(whole, "b", "left").where("NOT (same AND coalesce(met, false))").select("key"))
    if not apart.isEmpty():
        left = scratch.keep(tables.join(apart, "key").select(F.col("b").alias("grp"), "rep").distinct())
        count = scratch.keep(left.groupBy("grp").agg(F.count("*").alias("n")))
        left = left.join(count, "grp").join(member.select("rep", "shingles"), "rep")
        left = scratch.keep(left.select("grp", "n", "rep", "shingles"))
        links = scratch.keep(links.union(_links(left.where(F.col("n") <= BLOCK).select(F.col("grp").alias("k1"), F.lit(0).cast("long").alias("k2"), "rep", "shingles"), percent)))
        found = _across(left.where(F.col("n") > BLOCK), links, percent, scratch)
    node = classes.select("d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("cls"))
    # a doc_id on several rows may be in several classes: those are then one component
    own = usable.select("doc_id", "d1", "d2").join(node, ["d1", "d2"])
    repeated = own.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    bridged = repeated.where("lo <> hi")
    if not bridged.isEmpty():
        spread = own.join(bridged.select("doc_id", "lo"), "doc_id").select(F.col("cls").alias("a"), F.col("lo").alias("b"))
        merged = connected_components(spread, scratch)
        repeated = repeated.join(merged, F.col("lo") == F.col("node"), "left").select("doc_id", F.coalesce("component", "lo").alias("lo"))
    return signed.select("doc_id", "n_shingles").join(repeated.select("doc_id", "lo"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("lo", "doc_id").alias("component_id"))


def _across(large: DataFrame, links: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of all ``links`` and those within the groups of ``large`` (grp, rep, shingles), of which only members not yet in one component are compared."""
    found = connected_components(links, scratch)
    if large.isEmpty():
        return found
    for last in (False, True):
        state = large.join(found, F.col("rep") == F.col("node"), "left").select("grp", "rep", F.coalesce("component", "rep").alias("comp"), "shingles")
        state = scratch.keep(state)
        parts = scratch.keep(state.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.min("rep").alias("least")))
        split = scratch.keep(parts.groupBy("grp").agg(F.count("*").alias("comps"), F.sum("n").alias("n")).where("comps > 1"))
        if split.isEmpty():
            return found
        if not last:
            # one member of each component, in blocks: usually settles almost all
            few = state.join(parts.select("grp", F.col("least").alias("rep")), ["grp", "rep"], "left_semi").join(split, "grp").withColumn("k2", F.pmod(F.xxhash64("rep"), F.ceil(F.col("comps") / BLOCK)))
            links = scratch.keep(links.union(_links(few.select(F.col("grp").alias("k1"), "k2", "rep", "shingles"), percent)))
            found = connected_components(links, scratch)
            continue
        # what is left: blocks of one component each, or of many small ones; each two blocks meet unless both are of one component
        tagged = state.join(split.select("grp"), "grp").join(parts.select("grp", "comp", "n"), ["grp", "comp"])
        mixed = tagged.where(F.col("n") < WIDE).groupBy("grp").agg(F.count("*").alias("rest"))
        tagged = tagged.join(mixed, "grp", "left").withColumn("pure", F.col("n") >= WIDE)
        slot = F.when(F.col("pure"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / WIDE))).otherwise(F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("rest") / WIDE)))
        tagged = scratch.keep(tagged.select("grp", "rep", "shingles", F.when(F.col("pure"), F.col("comp")).alias("owner"), F.xxhash64("pure", F.when(F.col("pure"), F.col("comp")), slot).alias("blk")))
        blocks = tagged.select("grp", "blk", "owner").distinct()
        other = blocks.select("grp", F.col("blk").alias("blk2"), F.col("owner").alias("owner2"))
        meet = blocks.join(other, "grp").where("blk <= blk2 AND (owner IS NULL OR owner2 IS NULL OR owner <> owner2)")
        meet = meet.select("grp", F.xxhash64("grp", "blk", "blk2").alias("k2"), F.explode(F.array_distinct(F.array("blk", "blk2"))).alias("blk"))
        links = scratch.keep(links.union(_links(tagged.join(meet, ["grp", "blk"]).select(F.col("grp").alias("k1"), "k2", "rep", "shingles"), percent)))
    return connected_components(links, scratch)
