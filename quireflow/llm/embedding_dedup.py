"""Near-duplicate vectors by iterative quantisation and multi-index hashing.

Unit vectors are centred, rotated and reduced to sign bits. Each rotation is
learned by iterative quantisation, which alternates between the bits of the
sample and the orthogonal map that best carries the vectors onto them, so
that bits are balanced and near vectors seldom differ. The code is cut into
substrings, one hash table each; vectors that agree on a whole substring meet
there. Where a bucket has few members, those without another within the
Hamming radius leave it on their codes alone; what stays is compared by the
original vectors, in double precision.

How many tables there are follows from how often a pair at the threshold
agrees on a substring, as measured on the sample. If the most rotations allowed
don't give the recall asked for, substrings get shorter, down to none at all:
then all vectors are one bucket and every pair is compared. Vectors of
different dimensions never meet, each dimension has tables of its own.

A large bucket is cut into blocks of bounded size and blocks meet in pairs,
each compared by one matrix product that yields only counts and a spanning
forest, never the pairs. A pair that agrees in several tables counts in the
first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.graph import connected_components
from quireflow.llm.scratch import Scratch

#: Rows of the sample on which rotations are learned, and those of it on which recall is measured.
SAMPLE, PROBES = 20_000, 4096
#: The most rows of a bucket in one block.
BLOCK = 512
#: Blocks of so many rows or fewer are compared many at a time.
SMALL = 32
#: The most bits of a rotation and the most rotations: a model has at most their product of floats a dimension of the vectors.
BITS, ROTATIONS = 256, 16


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal map (dimensions x bits) learned by iterative quantisation of the centred rows of ``x``."""
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))
    basis = vectors[:, np.argsort(-values)[:bits]]
    v = x @ basis
    r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return basis @ r


class Codes:
    """Substring keys of unit vectors of one dimension: ``tables`` of them, ``width`` bits each; width 0 puts all in one bucket.

    ``recall`` is what share of sampled pairs at the threshold meet in a table.
    """

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, recall: float) -> None:
        self.maps: list[np.ndarray] = []
        self.width, self.tables, self.recall, self.radius = 0, 1, 1.0, 64
        if rows <= 2 * BLOCK or not len(sample):
            return
        dim = sample.shape[1]
        self.mean = sample.mean(axis=0)
        bits = min(dim, BITS)
        # pairs at the threshold: sampled vectors and a copy of each turned by that angle
        rng = np.random.default_rng(1)
        one = sample[rng.permutation(len(sample))[:PROBES]]
        turned = rng.standard_normal(one.shape)
        turned -= (turned * one).sum(axis=1, keepdims=True) * one
        turned /= np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-12)
        two = threshold * one + math.sqrt(max(0.0, 1 - threshold**2)) * turned
        equal: list[np.ndarray] = []  # by rotation: which bits of a pair agree
        # as many bits a table as tell the rows apart, fewer if that finds too little
        for width in range(max(1, min(bits, 62, round(math.log2(rows)))), 0, -1):
            missed, tables = np.ones(len(one), bool), 0
            for r in range(ROTATIONS):
                if r == len(equal):
                    self.maps.append(learn_rotation(sample - self.mean, bits, r))
                    equal.append(((one - self.mean) @ self.maps[r] >= 0) == ((two - self.mean) @ self.maps[r] >= 0))
                for t in range(bits // width):
                    missed &= ~equal[r][:, t * width : (t + 1) * width].all(axis=1)
                    tables += 1
                    if missed.mean() <= 1 - recall:
                        self.maps = self.maps[: r + 1]
                        self.width, self.tables, self.recall = width, tables, 1 - missed.mean()
                        self.radius = int((~equal[0][:, :64]).sum(axis=1).max()) + 2
                        return
        self.maps = []

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) substring keys, and the code whose Hamming distance tells far pairs."""
        if not self.width:
            return np.zeros((len(x), 1), np.int64), np.zeros(len(x), np.int64)
        weight, keys, code = np.int64(1) << np.arange(self.width), [], None
        for m in self.maps:
            bit = (x - self.mean) @ m >= 0
            if code is None:
                head = np.zeros((len(x), 64), bool)
                head[:, : min(64, bit.shape[1])] = bit[:, :64]
                code = np.packbits(head, axis=1).view(np.int64).ravel()
            keys += [bit[:, t * self.width : (t + 1) * self.width] @ weight for t in range(bit.shape[1] // self.width)]
        return np.stack(keys[: self.tables], axis=1), code


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = float) -> np.ndarray:
    """A column of lists of ``width`` values as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in chunks]
    return np.concatenate(parts or [np.zeros((0, width))]).astype(kind)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(table: int, side: np.ndarray, reps: np.ndarray, copies: np.ndarray, keys: np.ndarray, x: np.ndarray, threshold: float):
    """Of one block (all of side 0) or two (sides 1 and 2): rows with a link whose first common table this is, how many vectors they link with, and a root."""
    alone = not side.any()
    rows, cols = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    link = x[rows] @ x[cols].T >= threshold
    for t in range(table):
        link &= keys[rows, t][:, None] != keys[cols, t][None, :]
    if alone:
        np.fill_diagonal(link, False)
    n, label = np.zeros(len(reps), np.int64), reps.copy()
    n[rows] += link @ copies[cols]
    if not alone:
        n[cols] += link.T @ copies[rows]
    met = n > 0
    big = np.iinfo(np.int64).max
    while met.any():
        now = label.copy()
        now[rows] = np.minimum(now[rows], np.where(link, label[cols][None, :], big).min(axis=1, initial=big))
        now[cols] = np.minimum(now[cols], np.where(link, now[rows][:, None], big).min(axis=0, initial=big))
        if (now == label).all():
            break
        label = now
    return met, n, label


def small_links(size: np.ndarray, table: np.ndarray, side: np.ndarray, reps: np.ndarray, copies: np.ndarray, keys: np.ndarray, x: np.ndarray, threshold: float):
    """block_links() of many small blocks side by side, of ``size`` rows each."""
    place = np.arange(len(reps)) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(size, size) - 1 - place  # rows of the same block after each row
    n, label = np.zeros(len(reps), np.int64), reps.copy()
    two = np.repeat(np.maximum.reduceat(side, np.cumsum(size) - size) > 0, size)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    step, a = 1 << 15, 0
    upto = np.cumsum(after)
    while a < len(reps):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + step, "right")))
        i = np.repeat(np.arange(a, b), after[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[a:b]) - after[a:b], after[a:b])
        meet = ~two[i] | (side[i] != side[j])
        i, j = i[meet], j[meet]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[near], j[near]
        own = (keys[i] == keys[j]).argmax(axis=1) == table[i]
        kept.append((i[own], j[own]))
        a = b
    i, j = (np.concatenate(c) for c in zip(*kept)) if kept else (np.zeros(0, int), np.zeros(0, int))
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    while True:
        now = label.copy()
        np.minimum.at(now, i, label[j])
        np.minimum.at(now, j, now[i])
        if (now == label).all():
            return n > 0, n, label
        label = now


_PLACE = ("b1", "b2", "d", "t", "key")


def _runs(columns: list[np.ndarray]) -> list[int]:
    """Bounds of the runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), n]


def _compare(tables: dict[int, int], threshold: float):
    """Batches sorted by _PLACE, each place a block or two -> c1, c2, n, rep, root."""

    def measured(t: pa.Table, cuts: list[int]):
        table, side, dims, c1, c2, rep, copies = (t.column(c).to_numpy() for c in ("t", "side", "d", "c1", "c2", "rep", "copies"))
        size, head = np.diff(cuts), np.array(cuts[:-1])
        small = (size > 1) & (size <= SMALL)
        for d in np.unique(dims[head[size > 1]]).tolist():
            own = small & (dims[head] == d)
            if own.any():
                at = np.repeat(head[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))
                part = t.take(pa.array(at))
                met, n, root = small_links(size[own], table[at], side[at], rep[at], copies[at], _matrix(part.column("keys"), tables[d], np.int64), _unit(_matrix(part.column("embedding"), d)), threshold)
                yield c1[at][met], c2[at][met], n[met], rep[at][met], root[met]
            for k in np.flatnonzero((size > SMALL) & (dims[head] == d)).tolist():
                i, j = cuts[k], cuts[k + 1]
                part = t.slice(i, j - i)
                met, n, root = block_links(int(table[i]), side[i:j], rep[i:j], copies[i:j], _matrix(part.column("keys"), tables[d], np.int64), _unit(_matrix(part.column("embedding"), d)), threshold)
                yield c1[i:j][met], c2[i:j][met], n[met], rep[i:j][met], root[met]

    def flush(held):
        t = pa.Table.from_batches(held)
        found = list(measured(t, _runs([t.column(c).to_numpy() for c in _PLACE])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["c1", "c2", "n", "rep", "root"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = [batch.column(c).to_numpy() for c in _PLACE]
            if held and key != tuple(p[0] for p in place):
                yield from flush(held)
                held = []
            key, cut = tuple(p[-1] for p in place), _runs(place)[-2]
            if cut:
                yield from flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return run


def _close(radius: dict[int, int]):
    """(d, t, key, n, members: c1, c2, code) of small buckets -> c1, c2, t, key, n of members with another within the radius."""

    def run(batches):
        for batch in batches:
            members = batch.column(4)
            size = members.value_lengths().to_numpy()
            flat = members.flatten()
            code = flat.field(2).to_numpy().view(np.uint64)
            near = np.zeros(len(code), bool)
            most = np.array([radius[d] for d in batch.column(0).to_pylist()], np.int64)
            head = np.cumsum(size) - size
            for shift in range(1, int(size.max(initial=1))):  # each member and the one so many places on
                wide = np.flatnonzero(size > shift)
                n = size[wide] - shift
                i = np.repeat(head[wide] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                hit = np.bitwise_count(code[i] ^ code[i + shift]) <= np.repeat(most[wide], n)
                near[i[hit]] = near[i[hit] + shift] = True
            bucket = np.repeat(np.arange(batch.num_rows), size)
            rows, which = pa.array(np.flatnonzero(near)), pa.array(bucket[near])
            yield pa.RecordBatch.from_arrays([flat.field(0).take(rows), flat.field(1).take(rows), *(batch.column(c).take(which) for c in (1, 2, 3))], names=["c1", "c2", "t", "key", "n"])

    return run


def link_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id for each row of ``vectors`` (vec_id, embedding).

    Links join vectors of one dimension whose cosine is ``threshold`` or more.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; so do rows without an id, whose component is null. Each
    distinct vector is compared once and stands for its copies, which are
    links like others. Rows that repeat an id and vector count as one vector;
    rows that repeat an id with other vectors are one node of the components.
    Rotations are learned on about ``sample`` rows of a dimension; every row is
    indexed. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors", vectors)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))

    # classes of equal vectors by two unrelated hashes, named by their smallest id
    plain = F.transform("embedding", lambda v: v + 0.0)
    named = rows.select("vec_id", "embedding", *[F.when(sound, F.xxhash64(F.lit(i), plain)).alias(f"c{i}") for i in (1, 2)])
    sound_rows = named.where("c1 IS NOT NULL")
    members = sound_rows.select("c1", "c2", "vec_id").distinct()
    single = sound_rows.groupBy("c1", "c2").agg(F.first("embedding").alias("embedding"))
    classes = single.join(members.groupBy("c1", "c2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), ["c1", "c2"])
    classes = scratch.keep(classes.select("*", F.size("embedding").alias("d")))
    total = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}  # one number a dimension

    # models of the dimensions that need one, each learned on its own rows
    large = [d for d, n in total.items() if n > 2 * BLOCK]
    share, models = F.lit(0), {d: Codes(np.zeros((0, d)), n, threshold, recall) for d, n in total.items()}
    for d in large:
        share = F.when(F.col("d") == d, round(1e6 * min(1.0, max(1000, sample // len(large)) / total[d]))).otherwise(share)
    drawn = classes.where(F.pmod(F.xxhash64("c1", F.lit(5)), F.lit(1_000_000)) < share).select("d", "embedding").toArrow() if large else None
    for d in large:
        own = drawn.filter(pa.compute.equal(drawn.column("d"), d))
        models[d] = Codes(_unit(_matrix(own.column("embedding"), d)), total[d], threshold, recall)
    shared = spark.sparkContext.broadcast(models)

    def index(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                dims = part.column(5).to_numpy()
                tables = np.array([shared.value[d].tables for d in dims.tolist()], np.int64)
                offs = np.concatenate(([0], np.cumsum(tables)))
                keys, code = np.zeros(offs[-1], np.int64), np.zeros(len(dims), np.int64)
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    k, code[at] = shared.value[d].keys(_unit(_matrix(part.column(2).take(pa.array(at)), d)))
                    keys[offs[at][:, None] + np.arange(k.shape[1])] = k
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(code)], names=["c1", "c2", "embedding", "rep", "copies", "d", "keys", "code"])

    coded = scratch.keep(classes.mapInArrow(index, f"c1 long, c2 long, embedding {kind}, rep long, copies long, d int, keys array<long>, code long"))
    scratch.drop(classes)
    # which tables matter to a vector is found on narrow rows; the vectors themselves move once to be copied and once to their buckets
    entry = coded.select("c1", "c2", "d", "code", F.posexplode("keys").alias("t", "key"))
    sizes = scratch.keep(entry.groupBy("d", "t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = entry.join(sizes, ["d", "t", "key"])
    few = met.where(F.col("n") <= BLOCK).groupBy("d", "t", "key", "n").agg(F.collect_list(F.struct("c1", "c2", "code")).alias("members")).select("d", "t", "key", "n", "members")
    few = few.mapInArrow(_close({d: m.radius for d, m in models.items()}), "c1 long, c2 long, t int, key long, n long")
    shared_in = few.union(met.where(F.col("n") > BLOCK).select("c1", "c2", "t", "key", "n")).groupBy("c1", "c2").agg(F.collect_list(F.struct("t", "key", "n")).alias("found"))
    placed = coded.drop("code").join(shared_in, ["c1", "c2"]).select("*", F.explode("found").alias("f")).select("*", "f.*").drop("f", "found")
    # a bucket's blocks meet in pairs: a row goes to its own block and to its meeting with each other
    placed = placed.withColumn("p", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("c1", "t"), "p"))
    meet = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("p") - 1),
        lambda q: F.struct(F.least("own", q).alias("i"), F.greatest("own", q).alias("j"), F.when(F.col("own") == q, 0).when(F.col("own") < q, 1).otherwise(2).alias("side")),
    )
    dealt = placed.withColumn("m", F.explode(meet)).select(F.xxhash64("d", "t", "key").alias("b1"), F.xxhash64("m.i", "m.j").alias("b2"), "d", "t", "key", F.col("m.side").alias("side"), "c1", "c2", "rep", "copies", "keys", "embedding")
    dealt = dealt.repartition("b1", "b2").sortWithinPartitions(*_PLACE)
    found = scratch.keep(dealt.mapInArrow(_compare({d: m.tables for d, m in models.items()}, threshold), "c1 long, c2 long, n long, rep long, root long"))

    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    shared_ids = members.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")
    edges = edges.union(members.join(shared_ids, "vec_id").join(coded.select("c1", "c2", "rep"), ["c1", "c2"]).select("vec_id", "rep"))
    component = connected_components(edges, scratch)
    counts = found.groupBy("c1", "c2").agg(F.sum("n").alias("n"))
    per = coded.select("c1", "c2", "rep", "copies").join(counts, ["c1", "c2"], "left").join(component, F.col("rep") == F.col("node"), "left")
    per = scratch.keep(per.select("c1", "c2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")))
    return named.select("vec_id", "c1", "c2").join(per, ["c1", "c2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
