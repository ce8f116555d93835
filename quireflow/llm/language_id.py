"""Language identification by mixture inference.

Byte trigrams are counted by language over all training documents. Each
document is then taken as a mixture of the learned languages: expectation
maximisation estimates the proportions from its trigram likelihoods, and of
the nested sets of likeliest languages the one with the best penalised
likelihood stands; sets grow as long as some text is the better for it. The
prediction is the largest part of that set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from quireflow.llm import words as W
from quireflow.llm.names import free

BINS = 1 << 14
_STRETCH = 1 << 20
#: The model has BINS floats a language; more languages than this are refused, so it stays within 32 MB.
MOST_LANGUAGES = 500
#: Columns that predict() adds.
PREDICTED = ("lang_pred", "score", "n_langs", "fit")


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of the three bytes from the start of each character, ASCII letters folded.

    One a character, so that languages with accents don't weigh more.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = W._LOWER[data].astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bins = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)
    n = np.maximum(np.diff(offs) - 2, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(offs[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    starts = (data[at] & 0xC0) != 0x80
    return doc[starts], bins[at[starts]].astype(np.int64)


def _cells(data: np.ndarray, offs: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Trigram counts, BINS for each group of documents; a very long text is counted stretch by stretch."""
    if len(data) <= 4 * _STRETCH or len(offs) != 2:
        doc, bins = _trigrams(data, offs)
        return np.bincount(group[doc] * BINS + bins, minlength=groups * BINS)
    out = np.zeros(groups * BINS, np.int64)
    for a in range(0, len(data), _STRETCH):
        part = data[a : a + _STRETCH + 2]
        out += np.bincount(group[0] * BINS + _trigrams(part, np.array([0, len(part)]))[1], minlength=groups * BINS)
    return out


def _count(batches):
    """(lang, text) -> (lang, bin, n), summed over the task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi in W.slices(batch.column(1), 1 << 20):
            names = sorted(set(langs[lo:hi]))
            code = {x: i for i, x in enumerate(names)}
            own = np.array([code[x] for x in langs[lo:hi]], np.int64)
            got = _cells(*W.utf8(batch.column(1).slice(lo, hi - lo)), own, len(names)).reshape(len(names), BINS)
            for x, row in zip(names, got):
                total[x] = total[x] + row if x in total else row
    for x, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bin", "n"])


class Mixture:
    """Learned languages with their trigram likelihoods."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray) -> None:
        self.names = names
        smooth = counts + 0.5
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)) if names else np.zeros((BINS, 0), np.float32)
        self.prior = docs / max(docs.sum(), 1)

    def infer(self, data: np.ndarray, offs: np.ndarray, rounds: int = 10, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each document: the main language's index, its proportion, the size of the language set, and the log-likelihood a trigram above that of evenly spread ones."""
        docs, k = len(offs) - 1, len(self.names)
        best, share, size = np.full(docs, int(np.argmax(self.prior)) if k else -1), np.full(docs, self.prior.max() if k else 0.0), np.ones(docs, np.int64)
        fit = np.zeros(docs)
        cells = _cells(data, offs, np.arange(docs), docs) if k else np.zeros(0, np.int64)
        at = np.flatnonzero(cells)
        if not len(at):
            return best, share, size, fit
        n = cells[at].astype(np.float32)
        row = at // BINS
        has, head = np.unique(row, return_index=True)
        local = np.repeat(np.arange(len(has)), np.diff(np.append(head, len(row))))
        p = self.p[at % BINS]
        total = np.add.reduceat(n, head)

        def refine(pi: np.ndarray, times: int) -> np.ndarray:
            for _ in range(times):
                part = p * pi[local]
                part *= (n / np.maximum(part.sum(axis=1), 1e-30))[:, None]
                pi = np.add.reduceat(part, head, axis=0) / total[:, None]
            return pi

        def likelihood(pi: np.ndarray) -> np.ndarray:
            return np.add.reduceat(n * np.log(np.maximum((p * pi[local]).sum(axis=1), 1e-30)), head)

        pi = refine(np.full((len(has), k), 1 / k, np.float32), rounds)
        order = np.argsort(-pi, axis=1, kind="stable")
        one = np.add.reduceat(n[:, None] * np.log(p), head, axis=0)
        top = one.argmax(axis=1)
        likely = one.max(axis=1)
        value = likely - 0.5 * penalty * np.log(total + 1)
        chosen, part, used = top, np.ones(len(has), np.float32), np.ones(len(has), np.int64)
        for m in range(2, k + 1):
            kept = np.zeros_like(pi)
            np.put_along_axis(kept, order[:, :m], np.maximum(np.take_along_axis(pi, order[:, :m], axis=1), 1e-6), axis=1)
            kept = refine(kept / kept.sum(axis=1, keepdims=True), 3)
            raw = likelihood(kept)
            now = raw - 0.5 * penalty * (2 * m - 1) * np.log(total + 1)  # m languages and m - 1 free proportions
            better = now > value
            if not better.any():
                break
            likely, value = np.where(better, raw, likely), np.where(better, now, value)
            chosen, part, used = np.where(better, kept.argmax(axis=1), chosen), np.where(better, kept.max(axis=1), part), np.where(better, m, used)
        best[has], share[has], size[has], fit[has] = chosen, np.clip(part, 0, 1), used, likely / total + np.log(BINS)
        return best, share, size, fit


def fit(docs: DataFrame, lang: str = "lang") -> Mixture:
    """Learns from every row of ``docs`` with a non-null language; null texts count as empty."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs_of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(docs_of) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counted = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(docs_of)
    code = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), BINS))
    which = np.array([code[x] for x in counted.column("lang").to_pylist()], np.int64)
    counts[which, counted.column("bin").to_numpy()] = counted.column("n").to_numpy()
    return Mixture(names, counts, np.array([docs_of[x] for x in names], float))


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, n_langs, fit, from the text alone; columns so named are replaced.

    ``und`` with score 0 where the text is null or holds no letter, or where
    nothing was learned; texts of under three bytes get the commonest
    language and its share. ``fit`` is how much likelier a trigram of the text
    is (in logs) than one drawn evenly; below 0 the text is in no language
    learned. Repeated rows and null ids are rows like others.
    """
    docs = docs.drop(*PREDICTED)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, text = docs.columns, F.col("text").cast("string")
    letters_, text_ = free(kept, "letters", "as_text")
    # the text goes along once, unless it has to be cast to be read
    extra = [F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(letters_)]
    place = kept.index("text")
    if dict(docs.dtypes)["text"] != "string":
        extra, place = [*extra, text.alias(text_)], len(kept) + 1

    def run(batches):
        mixture = shared.value
        for batch in batches:
            column, has = batch.column(place), batch.column(len(kept))
            for lo, hi in W.slices(column, 1 << 20):
                for a in range(lo, hi, 256):
                    b = min(hi, a + 256)
                    best, share, size, fit = mixture.infer(*W.utf8(column.slice(a, b - a)))
                    letters = has.slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool) & (len(mixture.names) > 0)
                    names = [mixture.names[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
                    new = [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0).astype(float)), pa.array(np.where(letters, size, 0).astype(np.int32)), pa.array(np.where(letters, fit, 0.0))]
                    yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[: len(kept)]], *new], names=[*kept, *PREDICTED])

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("n_langs", IntegerType()).add("fit", DoubleType())
    return docs.select("*", *extra).mapInArrow(run, schema)


def fold(modulus: int, held: int):
    """Whether crc32 of doc_id as text leaves ``held``; a null id never does."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % modulus == held, F.lit(False))
