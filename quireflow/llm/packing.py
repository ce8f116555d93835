"""Best-fit-decreasing packing of token sequences into windows.

A document longer than a window is first cut into full windows; what is left
of each goes, longest first, into the open window it fits most tightly. Open
windows are found in a segment tree indexed by remaining capacity. Remainders
are packed in groups of bounded size, so no task grows with the corpus, and a
group of some thousands already leaves next to no padding.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.scratch import Scratch

#: Characters on which the two tokenizer libraries surely agree; a text with any other goes through ``tokenizers`` itself.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ſ]")


@lru_cache(maxsize=4)
def encoder(path: str):
    """texts -> lists of ids, as ``tokenizers`` gives them for the file at ``path`` (add_special_tokens=False).

    If the file is a byte-level BPE with a single merge table, plain texts are
    encoded by ``tiktoken`` with the same vocabulary, which gives the same ids
    several times faster.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = {t["content"] for t in spec.get("added_tokens", [])}
    fast = None
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout"):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in special}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]  # ids must rise with the merges for ids to serve as ranks
        if order[:1] > [-1] and all(x < y for x, y in zip(order, order[1:])):
            # fixed value: how byte-level BPE splits a text before merging
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        if fast is None:
            return [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]
        return [slow.encode(t, add_special_tokens=False).ids if _PLAIN.search(t) or any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode


class OpenWindows:
    """A segment tree over remaining capacities 0..size: the least capacity >= n that has an open window."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << (size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ids: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.ids[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) of the tightest window that holds ``need``."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.ids[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each item; items of equal length keep their order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        room, w = found or (size, opened)
        opened += found is None
        window[i], offset[i] = w, size - room
        if room > n:
            tree.add(room - n, w)
    return window, offset


def _tokenize(path: str, end_id: int, size: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, start, length, crc, total, tokens = [], [], [], [], [], []
                for doc, got in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    got = np.array([*got, end_id], "<u4")
                    for a in range(0, len(got), size):
                        piece = got[a : a + size]
                        ids.append(doc)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(got))
                        tokens.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip((ids, start, length, crc, total, tokens), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tokens"],
                )

    return run


def tokenize(docs: DataFrame, path: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row for each piece of at most ``size`` ids: full windows, then the remainder; ``tokens`` holds the ids as little-endian u32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenize(path, end_id, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tokens binary")


def _pack(size: int, group_rows: int):
    def flush(tables):
        t = pa.Table.from_batches(tables)
        group = t.column("_q_group").to_numpy()
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
            for lo in range(a, b, group_rows):
                hi = min(b, lo + group_rows)
                w, off = best_fit_decreasing(t.column("length").to_numpy()[lo:hi], size)
                # a group's windows: the group above, 2^24 windows of a chunk below
                base = (np.int64(group[a]) << 32) + ((lo - a) // group_rows << 24)
                out = t.slice(lo, hi - lo).drop_columns(["_q_tie", "_q_group"])
                out = out.append_column("sequence_id", pa.array(base + w)).append_column("offset", pa.array(off))
                yield from out.to_batches()

    def run(batches):
        held, last = [], None
        for batch in batches:  # sorted by group; groups are of bounded size
            if not batch.num_rows:
                continue
            g = batch.column(batch.schema.get_field_index("_q_group")).to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if last is not None and g[0] != last and held:
                yield from flush(held)
                held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield from flush(held)
                held = []
            held.append(batch.slice(cut))
            last = g[-1]
        if held:
            yield from flush(held)

    return run


def pack(pieces: DataFrame, size: int = 2048, group_rows: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of tokenize(), ``tokens`` optional).

    A full piece is a sequence of its own; the others are packed best-fit
    decreasing within groups of about ``group_rows`` pieces, dealt by a hash
    of what the piece is and of where its row lies, so that copies and rows
    that repeat spread like others. ``pieces`` must give the same rows in the
    same order each time (a written table does). An empty table gives an
    empty one.
    """
    rest = pieces.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group_rows))
    names = pieces.columns
    key = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    rest = rest.withColumn("_q_tie", key).withColumn("_q_group", F.pmod("_q_tie", F.lit(groups))).repartition(min(groups, 4096), "_q_group").sortWithinPartitions("_q_group", "_q_tie", "doc_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    packed = rest.mapInArrow(_pack(size, 4 * group_rows), schema)
    whole = pieces.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, with_tokens: bool = False) -> DataFrame:
    """Tokenises and packs every document: one row a piece.

    Null text counts as empty (the end id alone); repeated rows and null ids
    are packed like any other. Each id lies in exactly one piece; a sequence
    holds at most ``size`` ids and its pieces lie side by side from 0.
    """
    scratch = Scratch(docs.sparkSession, "pieces", docs)
    pieces = tokenize(docs, path, end_id, size)
    return pack(scratch.keep(pieces if with_tokens else pieces.drop("tokens")), size)
