"""A uniform shuffle into shards of exact size, by a communication matrix.

How many rows of each source partition go to each target block follows the
multivariate hypergeometric law that a uniform permutation of all rows
implies. The matrix of these counts is never written down: sources form a
binary tree, each node of which splits its counts between its two halves by
one draw with a seed of its own, so a task walks down to its own row. Each
partition then deals its rows out at random under its row, the rows are
exchanged once, and each block is permuted again. Blocks have about the same
few rows whatever the input's size and tile the shards, so no task ever holds
a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from quireflow.llm.names import free

#: numpy's exact sampler takes urns of fewer balls than this.
_NUMPY = 1_000_000_000


def blocks_a_shard(rows: int, shards: int, block_rows: int) -> int:
    return max(1, -(-rows // (shards * block_rows)))


def block_sizes(rows: int, shards: int, per: int) -> np.ndarray:
    """Rows of each block, ``per`` blocks a shard; shard sizes differ by one at most, and so do the blocks of a shard."""
    size = rows // shards + (np.arange(shards) < rows % shards)
    return ((size // per)[:, None] + (np.arange(per)[None, :] < (size % per)[:, None])).astype(np.int64).ravel()


def _stirling(n: float) -> float:
    """log n! less Stirling's formula, to double precision."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        s, e, j = (x - mean) * v, 2 * x * v, 1
        while True:
            e *= v * v
            now = s + e / (2 * j + 1)
            if now == s:
                return s
            s, j = now, j + 1
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log of the binomial law by its saddle point, as accurate for huge n as for small."""
    if x == 0:
        return n * math.log1p(-p) if p < q else n * math.log(q)
    if x == n:
        return n * math.log1p(-q) if q < p else n * math.log(p)
    c = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` balls drawn from ``good`` and ``bad`` are good, for urns of any size.

    Beyond numpy's range: ratio of uniforms against the law itself, whose
    logarithm is worked out by saddle points, so nothing is approximated but
    what floating point rounds.
    """
    total = good + bad
    if total < _NUMPY:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p, q = n / total, (total - n) / total

    def log_p(x: int) -> float:
        return _log_binomial(x, good, p, q) + _log_binomial(n - x, bad, p, q)

    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    top, mean = log_p(mode), n * (good / total)
    spread = math.sqrt(max(mean * (bad / total) * ((total - n) / max(total - 1, 1)), 0.0) + 0.5)
    # fixed values: width of the enclosing rectangle, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_p(x) - top:
            return x


def draw(rng: np.random.Generator, urn: np.ndarray, n: int) -> np.ndarray:
    """``n`` draws without replacement from an urn of so many balls a colour; urns beyond numpy's range are halved first."""
    total = int(urn.sum())
    if total < _NUMPY:
        return rng.multivariate_hypergeometric(urn, n, method="marginals")
    if len(urn) == 1:
        return np.array([n], np.int64)
    mid = min(max(int(np.searchsorted(np.cumsum(urn), total // 2)), 1), len(urn) - 1)
    left = int(urn[:mid].sum())
    x = hypergeometric(rng, left, total - left, n)
    return np.concatenate((draw(rng, urn[:mid], x), draw(rng, urn[mid:], n - x)))


def matrix_row(upto: np.ndarray, targets: np.ndarray, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, counts): one partition's row of the communication matrix, only what isn't zero.

    ``upto`` holds the rows of all partitions before each (and after the
    last). Every partition that walks down the tree draws the same splits.
    """
    lo, hi, node = 0, len(upto) - 1, 1
    at, urn = np.flatnonzero(targets), targets[targets > 0]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.Generator(np.random.PCG64([seed, node])), urn, int(upto[mid] - upto[lo]))
        if part < mid:
            urn, hi, node = left, mid, 2 * node
        else:
            urn, lo, node = urn - left, mid, 2 * node + 1
        at, urn = at[urn > 0], urn[urn > 0]
    return at, urn


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> np.ndarray:
    """All rows at once: row i sums to sources[i], column j to targets[j]."""
    upto = np.concatenate(([0], np.cumsum(sources))).astype(np.int64)
    out = np.zeros((len(sources), len(targets)), np.int64)
    for i in range(len(sources)):
        at, n = matrix_row(upto, np.array(targets, np.int64), i, seed)
        out[i, at] = n
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 17, block_rows: int = 1 << 12) -> DataFrame:
    """Every row of ``df`` with ``shard`` and ``slot``: a uniformly random deal with exact sizes.

    Shard sizes differ by one row at most; slots of a shard run from 0 without
    gaps. All columns are carried along whatever their names; columns named
    shard or slot are replaced. Rows are dealt as rows: equal texts, repeated
    rows and nulls need no care, and an empty table gives an empty one. The
    deal is fixed by the seed and the input's partitions, so a recomputed task
    deals alike.

    ``df`` must be a plan whose partitions hold the same rows in the same
    order each time it runs (a file scan with narrow steps is one).
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    part_, block_, row_, rank_ = free([*df.columns, "shard", "slot"], "part", "block", "row", "rank")
    numbered = df.withColumn(part_, F.spark_partition_id())
    counted = dict(numbered.groupBy(part_).count().collect())  # one number a partition
    upto = np.concatenate(([0], np.cumsum([counted.get(p, 0) for p in range(max(counted, default=-1) + 1)]))).astype(np.int64)
    rows = int(upto[-1])
    per = blocks_a_shard(rows, shards, block_rows)
    shared = spark.sparkContext.broadcast(upto)  # 8 bytes a partition
    columns = numbered.columns

    def deal(batches):
        labels, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if labels is None:
                part = batch.column(len(columns) - 1)[0].as_py()
                labels = np.repeat(*matrix_row(shared.value, block_sizes(rows, shards, per), part, seed))
                np.random.Generator(np.random.PCG64([seed, 0, part])).shuffle(labels)
            arrays = [*batch.columns, pa.array(labels[done : done + batch.num_rows].astype(np.int64)), pa.array(np.arange(done, done + batch.num_rows))]
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, block_, row_])

    schema = StructType([*numbered.schema.fields]).add(block_, LongType()).add(row_, LongType())
    dealt = numbered.mapInArrow(deal, schema)
    within = Window.partitionBy(block_).orderBy(F.xxhash64(F.lit(seed), part_, row_), part_, row_)
    out = dealt.withColumn(rank_, F.row_number().over(within) - 1)

    def long(x: int) -> Column:
        return F.lit(x).cast("long")

    shard = F.floor(F.col(block_) / per).cast("long")
    size = long(rows // shards) + F.when(shard < rows % shards, 1).otherwise(0)
    small, i = F.floor(size / per).cast("long"), F.pmod(F.col(block_), long(per))
    before = small * i + F.least(i, F.pmod(size, long(per)))  # rows of the shard's blocks before this one
    return out.select(*df.columns, shard.cast(IntegerType()).alias("shard"), (before + F.col(rank_)).alias("slot"))
