"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words, one as toxic and one as ordinary documents do: byte
n-grams within a word, up to ``ORDER``, each order interpolated with the next
lower by absolute discounting. N-grams of the highest order, and those at the
start of a word, count by the documents of the class that hold them; below
that an n-gram counts by the different bytes it follows in the class
(continuation counts). Inflected and compounded expressions thus share what
their stems teach. Both models end in one distribution, counted over the
different words of the whole corpus: what is rare in both classes costs both
the same and does not move the score.

A document is scored by the difference of the two log-likelihoods per word,
over the whole text and over its most toxic window of a few words; a logistic
curve, fitted on labelled rows kept out of the counts, turns both into a
probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import words as W
from quireflow.llm.scratch import Scratch

#: The longest n-gram, in bytes; at most 7, so that one fits a 64-bit key with its order.
ORDER = 6
#: Discounts of n-grams met once and more often: what is met once in a class is left wholly to the backoff.
ONCE, MORE = 1.0, 0.75
#: A text's toxicity is sought in windows of so many words.
WINDOW = 8
#: A single word's log ratio counts for so much at most.
MOST = 60.0
#: The classifier is fitted on at most about so many labelled documents a class, and so many bytes of them, so the model broadcast is bounded.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
_START, _END = 1, 2
_U = np.uint64


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, start and end of each word free of punctuation, word hashes, n + 1 first words."""
    data, offs = W.utf8(column)
    s, e, first = W.bounds(data, offs, W.PUNCTUATION)
    return W._LOWER[data], s, e, W.word_hashes(data, s, e, lower=True), first


def _gather(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes of the given words, side by side."""
    return data[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _grams(data: np.ndarray, n: np.ndarray):
    """Words side by side -> (key, word) of order 1, 2, ... at each byte of each word with its marks; key 0 where the word is too short."""
    size = n + 2
    head = np.cumsum(size) - size
    flat = np.full(int(size.sum()), _START, _U)
    flat[head + size - 1] = _END
    word = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(flat)) - head[word]
    flat[(place > 0) & (place < size[word] - 1)] = data
    code = np.zeros(len(flat), _U)
    for k in range(1, ORDER + 1):
        code[k - 1 :] |= flat[: len(flat) - k + 1] << _U(8 * (k - 1))
        yield k, np.where(place >= k - 1, code | (_U(k) << _U(56)), _U(0)), word


def _vocabulary(batches):
    """(class or null, text) -> word, n0, n1: the different words of a batch, and how many documents of each class hold them."""
    for batch in batches:
        label = batch.column(0).fill_null(2).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in W.slices(batch.column(1), 1 << 23):
            data, s, e, h, first = _tokens(batch.column(1).slice(lo, hi - lo))
            if not len(h):
                continue
            _, at, which = np.unique(h, return_index=True, return_inverse=True)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            kind = label[lo + doc]
            n = []
            for c in (0, 1):
                own = kind == c
                pair = np.unique(which[own] * np.int64(hi - lo) + doc[own])
                n.append(np.bincount(pair // (hi - lo), minlength=len(at)))
            size = (e - s)[at]
            text = _gather(data, s[at], size)
            offs = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offs), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([words, pa.array(n[0]), pa.array(n[1])], names=["word", "n0", "n1"])


def _count(batches):
    """(word, n0, n1), each word once -> key, n0, n1, types: n-grams by class, and in how many different words pairs of bytes stand."""
    for batch in batches:
        data, offs = W.utf8(batch.column(0).view(pa.string()))
        n0, n1 = (batch.column(i).to_numpy() for i in (1, 2))
        n = np.diff(offs)
        taught = (n0 + n1) > 0
        for k, key, word in _grams(data, n):
            use = key > 0 if k <= 2 else (key > 0) & taught[word]
            key, word = key[use], word[use]
            if not len(key):
                continue
            found, which = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(W.signed(found)),
                    pa.array(np.bincount(which, n0[word]).astype(np.int64)),
                    pa.array(np.bincount(which, n1[word]).astype(np.int64)),
                    pa.array(np.bincount(which) if k <= 2 else np.zeros(len(found), np.int64)),
                ],
                names=["key", "n0", "n1", "types"],
            )


@dataclass
class Models:
    """A hash table of n-grams: ``ratio`` is log P(toxic) / P(ordinary) of the last byte, ``left`` that of what the n-gram as a context leaves to lower orders."""

    keys: np.ndarray
    ratio: np.ndarray
    left: np.ndarray
    weights: np.ndarray

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or the last entry, which is neutral."""
        slots = len(self.keys) - 1
        out, todo = np.full(len(key), slots), np.flatnonzero(key)
        at = _slot(key[todo], slots)
        while len(todo):  # on from slot to slot until the key or an empty one
            there = self.keys[at]
            hit = there == key[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (slots - 1)
        return out

    def word_ratios(self, data: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each word."""
        if not len(n):
            return np.zeros(0)
        none = len(self.keys) - 1
        value, before = np.zeros(int((n + 2).sum())), None
        for k, key, word in _grams(data, n):
            at = self._find(key)
            if k > 1:
                # a context of order k - 1 ends one byte earlier; where the n-gram is not known, its context leaves all to lower orders
                context = np.concatenate(([none], before[:-1]))
                there = key > 0
                value = np.where(there & (at != none), self.ratio[at], np.where(there, value + self.left[context], value))
            before = at
        return np.bincount(word, value, minlength=len(n))

    def features(self, column: pa.Array) -> np.ndarray:
        """(n, 2): the mean ratio a word of the text, and of its most toxic window (short texts are filled up with neutral words)."""
        data, s, e, h, first = _tokens(column)
        if len(h):
            _, at, which = np.unique(h, return_index=True, return_inverse=True)
            size = (e - s)[at]
            ratio = np.clip(self.word_ratios(_gather(data, s[at], size), size), -MOST, MOST)[which]
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            again = np.zeros(len(h), bool)
            for j in range(1, WINDOW):  # a word counts once in a window
                again[j:] |= (h[j:] == h[:-j]) & (doc[j:] == doc[:-j])
            ratio[again] = 0
        else:
            ratio = np.zeros(0)
        total = np.concatenate(([0.0], np.cumsum(ratio)))
        n = np.diff(first)
        whole = total[first[1:]] - total[first[:-1]]
        top = whole / WINDOW
        long = np.flatnonzero(n >= WINDOW)
        if len(long):
            at = W.starts_within(first, WINDOW)
            count = n[long] - WINDOW + 1
            top[long] = np.maximum.reduceat((total[at + WINDOW] - total[at]) / WINDOW, np.cumsum(count) - count)
        return np.stack((whole / np.maximum(n, 1), top), axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.features(column)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40)))


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - (slots.bit_length() - 1))).astype(np.int64)


def _adjusted(counted: DataFrame) -> DataFrame:
    """(key, n0, n1, types) of all n-grams -> key, n0, n1 (as each order counts them), d0, d1 (sums of those that go on from it), types."""
    level, body = F.shiftrightunsigned("key", 56).cast("int"), F.col("key").bitwiseAND((1 << 56) - 1)
    # an n-gram without its first byte, and without its last
    mask = F.create_map(*[x for k in range(1, ORDER + 1) for x in (F.lit(k), F.lit((1 << 8 * (k - 1)) - 1).cast("long"))])
    one_less = F.shiftleft((level - 1).cast("long"), 56)
    after = counted.where(level > 1).select(body.bitwiseAND(mask[level]).bitwiseOR(one_less).alias("key"), *[(F.col(f"n{c}") > 0).cast("long").alias(f"a{c}") for c in (0, 1)])
    after = after.groupBy("key").agg(F.sum("a0").alias("a0"), F.sum("a1").alias("a1"))
    raw = (level == ORDER) | (F.call_function("shiftrightunsigned", body, 8 * (level - 1)) == _START)
    own = counted.join(after, "key", "left").select("key", "types", *[F.when(raw, F.col(f"n{c}")).otherwise(F.coalesce(f"a{c}", F.lit(0))).alias(f"n{c}") for c in (0, 1)])
    before = own.where(level > 1).groupBy(F.shiftrightunsigned(body, 8).bitwiseOR(one_less).alias("key")).agg(F.sum("n0").alias("d0"), F.sum("n1").alias("d1"))
    full = own.join(before, "key", "left").na.fill(0, ["d0", "d1"])
    # what counts once is left to the lower orders whole; it is only needed in the sums
    return full.where("n0 > 1 OR n1 > 1 OR d0 > 1 OR d1 > 1 OR types > 0")


def _build(counted: pa.Table) -> Models:
    """The models of a table as _adjusted() gives it."""
    key = counted.column("key").to_numpy().view(_U)
    order = np.argsort(key)
    key = key[order]
    n, sums = (np.stack([counted.column(f"{x}{c}").to_numpy()[order] for c in (0, 1)], axis=1).astype(float) for x in "nd")
    types = counted.column("types").to_numpy()[order].astype(float)
    level = (key >> _U(56)).astype(int)
    body = key & _U((1 << 56) - 1)

    def find(what: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of order ``k`` are, and whether they are there."""
        what = what | _U(k << 56)
        at = np.minimum(np.searchsorted(key, what), max(len(key) - 1, 0))
        return at, key[at] == what

    p, left = np.ones((len(key), 2)), np.ones((len(key), 2))

    def lower(what: np.ndarray, k: int) -> np.ndarray:
        """Both classes' probability of the last byte after k - 1 others, backed off as far as it takes."""
        out, weight, todo = np.ones((len(what), 2)), np.ones((len(what), 2)), np.ones(len(what), bool)
        for j in range(k, 0, -1):
            if j == 1:
                break
            what = what & _U((1 << 8 * j) - 1)
            at, there = find(what, j)
            out = np.where((todo & there)[:, None], weight * p[at], out)
            todo &= ~there
            if not todo.any():
                return out
            context, known = find(what >> _U(8), j - 1)
            weight = np.where(known[:, None], weight * left[context], weight)
        return np.where(todo[:, None], weight * 0.5 / 128, out)

    for k in range(2, ORDER + 1):
        own = np.flatnonzero(level == k)
        if not len(own):
            continue
        context, known = find(body[own] >> _U(8), k - 1)
        total = np.where(known[:, None], sums[context], 0)
        mass = np.maximum(n[own] - np.where(n[own] > 1, MORE, ONCE), 0) / np.maximum(total, 1)
        used = np.stack([np.bincount(context[known], mass[known, c], minlength=len(key)) for c in (0, 1)], axis=1)
        met = np.unique(context[known])
        # a class that never met the context, and any rounding, leaves all to the lower order
        left[met] = np.clip(1 - used[met], 1e-4, 1)
        if k == 2:
            rest = ((types[own] + 0.5) / (np.where(known, types[context], 0) + 128))[:, None]
        else:
            rest = lower(body[own], k - 1)
        p[own] = mass + np.where(known[:, None], left[context], 1) * rest
    slots = 1 << max(10, int(2 * len(key)).bit_length())
    table, place = np.zeros(slots + 1, _U), np.zeros(len(key), np.int64)
    todo, at = np.arange(len(key)), _slot(key, slots)
    while len(todo):
        empty = table[at] == 0
        got, one = np.unique(at[empty], return_index=True)  # of several keys for a free slot the first takes it
        won = np.flatnonzero(empty)[one]
        table[got], place[todo[won]] = key[todo[won]], got
        lost = np.ones(len(todo), bool)
        lost[won] = False
        todo, at = todo[lost], (at[lost] + 1) & (slots - 1)
    ratio, rest = np.zeros(slots + 1, np.float32), np.zeros(slots + 1, np.float32)
    ratio[place], rest[place] = np.log(p[:, 1] / p[:, 0]), np.log(left[:, 1] / left[:, 0])
    return Models(table, ratio, rest, np.array([0.0, 0.0, 1.0]))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lightly ridged logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.array([-4.0 if not len(y) or y.max() == 0 else 4.0, 0.0, 0.0])
    a = np.concatenate((np.ones((len(y), 1)), x), axis=1)
    spread = np.maximum(a.std(axis=0), 1e-6)
    spread[0] = 1
    a = a / spread
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-1 * np.eye(3), a.T @ (y - p) - 1e-1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b / spread


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Models:
    """Learns from ``docs`` whose id has a label in ``labels`` (doc_id, toxic).

    Class counts and the logistic curve come from at most about ``sample``
    documents and ``sample_bytes`` bytes a class, chosen by a hash of the id;
    the shared counts come from the different words of every document. Null
    labels are ignored; of several labels of an id the largest counts; labels
    without a document and empty tables simply teach nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity", docs)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("_q_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).cast("long").alias("size"))
    per = marked.join(sizes, F.col("doc_id") == F.col("_q_id")).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # one row a class
    draw = F.pmod(F.xxhash64("_q_id", F.lit(9)), F.lit(1_000_000))
    keep = F.lit(False)
    for r in per:
        keep = keep | ((F.col("toxic") == r["toxic"]) & (draw < round(1_000_000 * min(1.0, sample / r["n"], sample_bytes / max(r["size"] or 1, 1)))))
    chosen = marked.where(keep).select("_q_id", "toxic", (F.pmod(F.xxhash64("_q_id", F.lit(10)), F.lit(5)) == 0).alias("apart"))
    chosen = F.broadcast(scratch.keep(chosen))  # at most about 2 * sample rows
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    taught = text.join(chosen, F.col("doc_id") == F.col("_q_id"), "left")
    words = taught.select(F.when(~F.col("apart"), F.col("toxic")).alias("toxic"), "text").mapInArrow(_vocabulary, "word binary, n0 long, n1 long")
    words = words.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = words.mapInArrow(_count, "key long, n0 long, n1 long, types long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("types").alias("types"))
    counted = _adjusted(scratch.keep(counted)).toArrow()  # bounded by the sample, and pairs of bytes
    models = _build(counted)
    shared = spark.sparkContext.broadcast(models)

    def measure(batches):
        for batch in batches:
            for lo, hi in W.slices(batch.column(1)):
                x = shared.value.features(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "x0", "x1"])

    held = taught.where("apart").select(F.col("toxic").cast("double").alias("toxic"), "text")
    got = held.mapInArrow(measure, "y double, x0 double, x1 double").toArrow()  # at most about 2 * sample rows
    x = np.stack([got.column(c).to_numpy() for c in ("x0", "x1")], axis=1)
    models.weights = _fit_logistic(x, got.column("y").to_numpy())
    return models


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id and score for each row, from the text alone; null and empty texts get the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for lo, hi in W.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(batch.column(1).slice(lo, hi - lo)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
