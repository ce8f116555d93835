"""Repeated word spans by De Bruijn compaction.

The edges are the k-mers of words (windows of ``k`` consecutive words), and a
document is a walk over them. Writing out one row an edge would cost many
times the text, so walks are cut into pieces as they are read: every edge
contains a minimiser (the leftmost least-hashed ``m`` words in it), and
consecutive edges that share one minimiser occurrence form a piece, within
which no walk branches. Joins then do the rest:

1. minimisers met once cannot lie in a repeated edge; a semi-join drops their pieces;
2. equal pieces collapse to one node of the graph, named by its first coordinate;
3. a successor join finds the nodes that every walk leaves for one and the same next node, which every walk enters
   from there; chains of such nodes are the nonbranching paths, each one row with its first coordinate and length;
4. only where one minimiser has several different pieces may edges be shared that pieces don't show; there the
   first occurrence of each piece is taken apart into edges, which join by their own hash;
5. the words at the first coordinates of each repeated path and edge are read and digested, and a later span is cut
   only if the words at its own coordinates have that digest.

Pieces and edges are equal by two unrelated 64-bit hashes, the digest of step
5 is a third one. A hot minimiser only meets plain joins, which adaptive
execution splits, and partial aggregates. A document is the unit of the steps
3 and 5, nothing larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm import words as W
from quireflow.llm.scratch import Scratch

#: Multiplier and word-hash seed of the two content hashes; the digest has the third seed.
_FIRST, _SECOND, _THIRD = (0xD6E8FEB86659FD93, 0), (0xA0761D6478BD642F, 1), 2


class _Spans:
    """Content hashes of short spans of a word-hash sequence, by prefix sums."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        n = len(h)
        self.down = W._powers(pow(base, -1, 1 << 64), n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * W._powers(base, n + 1)[:n], out=self.total[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return W.mix((self.total[start + length] - self.total[start]) * self.down[start] + length.astype(np.uint64))


def _digests(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One strong digest of the words of each span, whatever its length; ``h`` are their hashes under the third seed."""
    raw, end = memoryview(h.tobytes()), start + length
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(start.tolist(), end.tolist())], np.uint64)


def _pieces(k: int, m: int):
    """(doc_id, text) batches -> one row for each piece of each document's walk, with the hash of the piece after it."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(batch.column(1)):
                data, offs = W.utf8(batch.column(1).slice(lo, hi - lo))
                s, e, first = W.bounds(data, offs)
                win = W.starts_within(first, k)
                if not len(win):
                    continue
                h = W.word_hashes(data, s, e, seed=_FIRST[1])
                gram = W.rolling(h, m)
                at = win + np.lib.stride_tricks.sliding_window_view(gram, k - m + 1)[win].argmin(axis=1)
                doc = np.searchsorted(first, win, "right") - 1
                new = np.ones(len(win), bool)
                new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(win)))
                start, length = win[head], n + k - 1
                s1 = W.signed(_Spans(h, _FIRST[0]).of(start, length))
                s2 = W.signed(_Spans(W.word_hashes(data, s, e, seed=_SECOND[1]), _SECOND[0]).of(start, length))
                last = np.ones(len(head), bool)
                last[:-1] = doc[head[1:]] != doc[head[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.signed(gram[at[head]])),
                        pa.array(ids[lo + doc[head]].astype(np.int64)),
                        pa.array((start - first[doc[head]]).astype(np.int32)),
                        pa.array(n.astype(np.int16)),
                        pa.array(s1),
                        pa.array(s2),
                        pa.array(np.append(s1[1:], 0), mask=last),
                    ],
                    names=["a", "doc_id", "start", "n", "s1", "s2", "after"],
                )

    return run


def _read(k: int):
    """(doc_id, text, paths, forks) -> w1, w2, doc_id, start, length, digest: each path whole, and the single edges of each fork's piece."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(batch.column(1)):
                data, offs = W.utf8(batch.column(1).slice(lo, hi - lo))
                s, e, first = W.bounds(data, offs)
                h1, h2, h3 = (W.word_hashes(data, s, e, seed=x) for x in (_FIRST[1], _SECOND[1], _THIRD))
                of1, of2 = _Spans(h1, _FIRST[0]), _Spans(h2, _SECOND[0])
                for column, whole in ((2, True), (3, False)):
                    wanted = batch.column(column).slice(lo, hi - lo)
                    row, flat = np.repeat(np.arange(hi - lo), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), wanted.flatten()
                    start, length = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
                    if not whole:  # a piece of n edges -> its edges
                        row = np.repeat(row, length)
                        start = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                        length = np.full(len(row), k)
                    fits = start + length <= np.diff(first)[row]  # rows that repeat an id with another text
                    row, start, length = row[fits], start[fits], length[fits]
                    at, none = first[row] + start, np.full(len(row), whole)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.zeros(len(row), np.int64) if whole else W.signed(of1.of(at, length)), mask=none),
                            pa.array(np.zeros(len(row), np.int64) if whole else W.signed(of2.of(at, length)), mask=none),
                            pa.array(ids[lo + row].astype(np.int64)),
                            pa.array(start.astype(np.int32)),
                            pa.array(length.astype(np.int32)),
                            pa.array(W.signed(_digests(h3, at, length))),
                        ],
                        names=["w1", "w2", "doc_id", "start", "length", "digest"],
                    )

    return run


def _cut(batches):
    """(doc_id, text, spans) -> doc_id, kept_text, n_words, n_removed."""
    for batch in batches:
        for lo, hi in W.slices(batch.column(1)):
            data, offs = W.utf8(batch.column(1).slice(lo, hi - lo))
            s, e, first = W.bounds(data, offs)
            spans = batch.column(2).slice(lo, hi - lo)
            lengths = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            drop = np.zeros(len(s), bool)
            if len(flat):
                row = np.repeat(np.arange(hi - lo), lengths)
                start, length, said = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64), flat.field(2).to_numpy().view(np.uint64)
                fits = start + length <= np.diff(first)[row]
                at, length, said = (first[row] + start)[fits], length[fits], said[fits]
                true = _digests(W.word_hashes(data, s, e, seed=_THIRD), at, length) == said
                step = np.zeros(len(s) + 1, np.int64)
                np.add.at(step, at[true], 1)
                np.add.at(step, (at + length)[true], -1)
                drop = np.cumsum(step[:-1]) > 0
            texts, raw = [], data.tobytes()
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                if drop[a:b].any():
                    texts.append(b" ".join([raw[s[j] : e[j]] for j in (a + np.flatnonzero(~drop[a:b])).tolist()]).decode())
                else:
                    texts.append(b" ".join(raw[offs[i] : offs[i + 1]].split()).decode())
            gone = np.concatenate(([0], np.cumsum(drop)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(gone[first[1:]] - gone[first[:-1]])],
                names=["doc_id", "kept_text", "n_words", "n_removed"],
            )


def _paths(nodes: DataFrame, k: int) -> DataFrame:
    """Repeated nodes -> a, s1, s2 (the path's first piece), f (its first coordinate), length in words.

    The edge from one node to the next is nonbranching if all walks through
    either take it: each occurrence of the one goes on to the other, and both
    occur equally often. First occurrences then lie side by side, too.
    """
    ends = nodes.where("onward IS NOT NULL").select(F.col("f.doc_id").alias("pd"), (F.col("f.start") + F.col("n")).alias("pn"), F.col("f.start").alias("ps"), F.col("onward").alias("p1"), F.col("c").alias("pc"))
    entered = nodes.join(ends, (nodes["f.doc_id"] == ends["pd"]) & (nodes["f.start"] == ends["pn"]) & (nodes["s1"] == ends["p1"]) & (nodes["c"] == ends["pc"]), "left")
    walk = Window.partitionBy("f.doc_id").orderBy("f.start", "s1", "s2", "a")
    # the node before must lie just before it, which it may not where rows repeat an id with several texts
    entered = entered.select("a", "s1", "s2", "f", "n", (~F.coalesce(F.lag("f.start").over(walk) == F.col("ps"), F.lit(False))).alias("head"))
    numbered = entered.withColumn("path", F.sum(F.col("head").cast("int")).over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min(F.struct("f", "a", "s1", "s2")).alias("h")
    return numbered.groupBy(F.col("f.doc_id"), "path").agg(start, F.sum("n").alias("n")).select("h.a", "h.s1", "h.s2", "h.f", (F.col("n") + F.lit(k - 1)).cast("int").alias("length"))


def remove_repeated_spans(docs: DataFrame, k: int = 20, m: int = 6) -> DataFrame:
    """Cut every word covered by a ``k``-word window whose words also start earlier.

    Earlier is a smaller doc_id, or the same document and a smaller position;
    windows are judged on the input. Returns doc_id, kept_text (kept words
    joined by one space), n_words and n_removed for each input row.

    Null or empty text: no words, kept_text "". Null doc_id: no window of it
    counts and nothing is cut. Rows that repeat doc_id and text count as one
    document, so none is cut because of the other; where rows repeat a doc_id
    with another text, a span is cut only from rows that hold it. Texts of
    fewer than ``k`` words have no window. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans", docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = text.where("doc_id IS NOT NULL")
    pieces = known.mapInArrow(_pieces(k, m), "a long, doc_id long, start int, n short, s1 long, s2 long, after long")
    # counts are written before they are joined: only a join of two exchanges can be split at a hot key
    again = scratch.keep(pieces.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"))
    shared = scratch.keep(pieces.join(again, "a", "left_semi"))
    only = F.when((F.min("after") == F.max("after")) & (F.count("after") == F.count("*")), F.min("after")).alias("onward")
    nodes = scratch.keep(shared.groupBy("a", "s1", "s2").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("n").alias("n"), F.count("*").alias("c"), only))
    scratch.drop(again)
    paths = scratch.keep(_paths(nodes.where("c > 1"), k))
    forked = scratch.keep(nodes.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"))
    # what is read again at its first coordinates: paths whole, pieces of a forked minimiser edge by edge
    forks = nodes.join(forked, "a", "left_semi").select(F.col("f.doc_id").alias("doc_id"), F.lit(False).alias("whole"), F.struct(F.col("f.start").alias("start"), F.col("n").cast("int").alias("length")).alias("at"))
    wanted = paths.select(F.col("f.doc_id").alias("doc_id"), F.lit(True).alias("whole"), F.struct(F.col("f.start").alias("start"), "length").alias("at")).unionByName(forks)
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.when(F.col("whole"), F.col("at"))).alias("paths"), F.collect_list(F.when(~F.col("whole"), F.col("at"))).alias("forks"))
    read = known.join(wanted, "doc_id").select("doc_id", "text", "paths", "forks")
    read = scratch.keep(read.mapInArrow(_read(k), "w1 long, w2 long, doc_id long, start int, length int, digest long"))

    digests = read.where("w1 IS NULL").select(F.struct("doc_id", "start").alias("f"), "length", "digest").distinct()
    sealed = scratch.keep(paths.join(digests, ["f", "length"]))
    later = shared.select("a", "s1", "s2", "doc_id", "start").join(sealed, ["a", "s1", "s2"]).where("doc_id <> f.doc_id OR start <> f.start").select("doc_id", "start", "length", "digest")
    edges = read.where("w1 IS NOT NULL")
    first = F.min(F.struct("doc_id", "start", "digest")).alias("f")
    origin = scratch.keep(edges.groupBy("w1", "w2").agg(first, F.count("*").alias("c")).where("c > 1").select("w1", "w2", "f"))
    again_met = edges.select("w1", "w2", "doc_id", "start", "length").join(origin, ["w1", "w2"]).where("doc_id <> f.doc_id OR start <> f.start")
    later = later.unionByName(again_met.select("doc_id", "start", "length", F.col("f.digest").alias("digest")))
    spans = later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "digest")).alias("spans"))
    return text.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, kept_text string, n_words long, n_removed long")
