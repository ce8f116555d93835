"""Benchmark decontamination by templates, in DataFrame operations only.

Names, numbers and units are replaced by typed placeholders in documents and
benchmark items alike, so that a question asked again with other values keeps
its template. Windows of template words are joined by hash: every window of
an item with windows of a document at a fixed stride, which finds any common
run of window + stride - 1 words; an item too short for that has one window,
its most telling one, joined with the windows at every word. Each alignment
found is then read word by word, and the values in the slots of a run must map
consistently: one item value always to the same document value (two item
values may become one). A run is judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.names import free

#: Template words a window, words between the starts of a document's windows, and words of a short item's window.
WINDOW, STRIDE, SHORT = 8, 4, 4
#: A leak is a common run of so many template words, or all but one word of a shorter item.
RUN = 12
#: Runs with fewer words that are no placeholders, or names that stayed the same, say nothing about their origin.
LITERAL = 4
#: Benchmark windows, and words of benchmark items, up to which they are broadcast (some 100 bytes each in a hash table).
BROADCAST_ROWS = 300_000

_NAME, _NUMBER, _UNIT = "\ue001", "\ue002", "\ue003"
# fixed values: units of measure that may follow a number
_UNITS = "mm|cm|m|km|inch|inches|feet|foot|ft|yard|yards|mile|miles|mg|g|kg|gram|grams|kilogram|kilograms|ton|tons|lb|lbs|pound|pounds|ounce|ounces|ml|l|litre|litres|liter|liters|gallon|gallons|second|seconds|sec|minute|minutes|min|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|percent|mph|kmh|degree|degrees|watt|watts|volt|volts|joule|joules|byte|bytes|kb|mb|gb"


def raw_words(text: Column) -> Column:
    """Numbers and runs of letters, as written."""
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{M}]+"), F.lit(0))


def template_words(text: Column) -> Column:
    """raw_words() lower-cased, with placeholders: any capitalised word is a name, also at the start of a sentence."""
    out = F.regexp_replace(F.regexp_replace(text, f"[{_NAME}-{_UNIT}]", " "), r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})\p{Ll}+(?![\p{L}\p{M}])", _NAME)
    out = F.regexp_replace(F.lower(out), r"\p{Nd}+(?:[.,]\p{Nd}+)*", _NUMBER)
    out = F.regexp_replace(out, rf"(?<={_NUMBER}) ?(?:{_UNITS})(?![\p{{L}}\p{{M}}])", f" {_UNIT}")
    return F.regexp_extract_all(out, F.lit(rf"[{_NAME}-{_UNIT}]|[\p{{L}}\p{{M}}]+"), F.lit(0))


def _slot(word: Column) -> Column:
    return word.isin(_NAME, _NUMBER, _UNIT)


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~_slot(w)))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, ic, ir: template and raw words of each different item, under its smallest id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), template_words(text).alias("ic"), raw_words(text).alias("ir"))
    return items.where(F.size("ir") > 0).groupBy("ic", "ir").agg(F.min("item_id").alias("item_id"))


def _window(words: Column, start: Column, width: int) -> Column:
    """A window's hash; windows of different widths never meet."""
    return F.xxhash64(F.lit(width), F.slice(words, start + 1, width))


def _telling() -> Column:
    """Whether an item says enough to be known by its template; others must be met as they are written."""
    literals = _literals(F.col("ic"))
    return (F.size("ic") > LITERAL) & (literals + F.size(F.filter("ic", lambda w: w == _NAME)) >= LITERAL) & (literals > 0)


def _item_windows(items: DataFrame) -> DataFrame:
    """(h, item_id, j, n): all windows of each item that hold a word which is no placeholder, or the best one of a short item."""
    n = F.size("ic")
    short = n < WINDOW + STRIDE
    starts = F.sequence(F.lit(0), n - WINDOW)
    best = F.array_max(F.transform(F.sequence(F.lit(1), n - SHORT - 1), lambda j: F.struct(_literals(F.slice("ic", j + 1, SHORT)).alias("literals"), (-j).alias("at"))))
    long_ = items.where(~short).select("item_id", "ic", n.alias("n"), F.explode(starts).alias("j"))
    long_ = long_.where(_literals(F.slice("ic", F.col("j") + 1, WINDOW)) > 0).select(_window(F.col("ic"), F.col("j"), WINDOW).alias("h"), "item_id", "j", "n")
    # the inner words, as a leak may lack the first or the last
    inner = items.where(short & (n >= SHORT + 2)).select("item_id", "ic", n.alias("n"), (-best["at"]).alias("j"))
    five = items.where(n == SHORT + 1).select("item_id", "ic", n.alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return long_.union(inner.union(five).select(_window(F.col("ic"), F.col("j"), SHORT).alias("h"), "item_id", "j", "n"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): which documents hold how long a run of which item.

    Null texts are empty. Items of LITERAL words or fewer, or with too few
    words besides placeholders, are met only as a whole line or sentence with
    the same words and values. Equal items count under their smallest id,
    items without an id or a word not at all. Rows that repeat a doc_id are
    searched each on its own text and reported under the common id; so are
    rows with a null id. Other columns are not read; an empty table on either
    side gives no row.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = _items(benchmark)
    known = items.where(_telling())
    windows = _item_windows(known)
    kinds = windows.groupBy((F.col("n") < WINDOW + STRIDE).alias("short")).agg(F.count("*").alias("n")).collect()  # two numbers
    total = sum(r["n"] for r in kinds)
    small = total <= BROADCAST_ROWS and (known.agg(F.sum(F.size("ic"))).first()[0] or 0) <= BROADCAST_ROWS
    tiles = [_tiles()] + [_every(SHORT)] * any(r["short"] for r in kinds)
    words = text.select("doc_id", template_words(F.col("text")).alias("w"))
    hits = words.select("doc_id", F.explode(F.concat(*tiles)).alias("t")).select("doc_id", F.col("t.i").alias("i"), F.col("t.h").alias("h"))
    hits = hits.join(F.broadcast(windows) if small else windows, "h").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift"), "n").distinct()
    # only numbers are gathered for a document; of its words each alignment takes those beside the item
    (id_,) = free(text.columns, "id")
    aligned = hits.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list(F.struct("item_id", "shift", "n")).alias("found"))
    read = text.join(aligned, text["doc_id"].eqNullSafe(aligned[id_])).select("doc_id", "found", template_words(F.col("text")).alias("dc"), raw_words(F.col("text")).alias("dr"))

    def beside(f: Column) -> Column:
        lo = F.greatest(f["shift"], F.lit(0))
        n = F.greatest(F.least(F.size("dc"), f["shift"] + f["n"]) - lo, F.lit(0))
        return F.struct(f["item_id"].alias("item_id"), (lo - f["shift"]).alias("lo"), n.alias("size"), F.slice("dc", lo + 1, n).alias("dc"), F.slice("dr", lo + 1, n).alias("dr"))

    part = read.select("doc_id", F.inline(F.transform("found", beside)))
    part = part.join(F.broadcast(known) if small else known, "item_id").withColumn("n", F.size("ic"))
    part = part.withColumns({c: F.slice(c, F.col("lo") + 1, F.col("size")) for c in ("ic", "ir")})
    # every run of equal template words that is long enough
    least_run = F.least(F.lit(RUN), F.col("n") - 1)
    none = F.array().cast("array<struct<start:int,size:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), none.alias("runs"))

    def closed(a: Column) -> Column:
        run = F.struct((a["at"] - a["run"]).alias("start"), a["run"].alias("size"))
        return F.when(a["run"] >= least_run, F.concat(a["runs"], F.array(run))).otherwise(a["runs"])

    def step(a: Column, same: Column) -> Column:
        run = F.when(same, a["run"] + 1).otherwise(F.lit(0))
        return F.struct((a["at"] + 1).alias("at"), run.alias("run"), F.when(same, a["runs"]).otherwise(closed(a)).alias("runs"))

    runs = F.aggregate(F.zip_with("dc", "ic", lambda x, y: x == y), zero, step, closed)
    part = part.select("*", F.explode(runs).alias("r"))
    start, size = F.col("r.start"), F.col("r.size")
    part = part.select("doc_id", "item_id", size.alias("words"), *[F.slice(c, start + 1, size).alias(c) for c in ("ic", "ir", "dr")])
    # slots: what an item value becomes must be one value
    filled = F.filter(F.arrays_zip("ic", "ir", "dr"), lambda x: _slot(x["ic"]))
    pairs = F.array_distinct(F.transform(filled, lambda x: F.struct(x["ir"], x["dr"])))
    values = F.array_distinct(F.transform(filled, lambda x: x["ir"]))
    same_names = F.size(F.filter(filled, lambda x: (x["ic"] == _NAME) & (x["ir"] == x["dr"])))
    part = part.where((_literals(F.col("ic")) + same_names >= LITERAL) & (F.size(pairs) == F.size(values))).select("doc_id", "item_id", "words")
    whole = items.where(~_telling())
    if not whole.isEmpty():
        part = part.union(_as_written(text, whole))
    return part.groupBy("doc_id", "item_id").agg(F.max("words").cast("long").alias("words"))


def _as_written(text: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, words): items that are, word for word, a whole line or sentence of a document; letter case does not count."""
    line = lambda words: F.lower(F.array_join(words, " "))
    lines = F.array_distinct(F.transform(F.split("text", r"[.!?;:\n\r]+(?![\p{Nd}])"), lambda s: line(raw_words(s))))
    each = text.select("doc_id", F.explode(lines).alias("line"))
    return each.join(items.select("item_id", line(F.col("ir")).alias("line"), F.size("ir").alias("words")), "line").select("doc_id", "item_id", "words")


def _starts(width: int, stride: int) -> Column:
    return F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _every(width: int) -> Column:
    return F.transform(_starts(width, 1), lambda i: F.struct(i.alias("i"), _window(F.col("w"), i, width).alias("h")))


def _tiles() -> Column:
    """Windows at the stride; in a text with a window of placeholders alone also those at such windows' edges.

    Windows of placeholders alone are not indexed, or every table of numbers
    would meet every list of numbers. A run that holds one and any other word
    also holds such an edge, so no run is lost.
    """
    starts = _starts(WINDOW, STRIDE)
    hollow = lambda i: F.forall(F.slice("w", i + 1, WINDOW), _slot)
    starts = F.when(F.exists(starts, hollow), F.concat(starts, F.filter(_starts(WINDOW, 1), _edge))).otherwise(starts)
    return F.transform(starts, lambda i: F.struct(i.alias("i"), _window(F.col("w"), i, WINDOW).alias("h")))


def _edge(i: Column) -> Column:
    """Whether the window of placeholders at ``i`` has another word at one end only."""
    first, last = F.get("w", i), F.get("w", i + WINDOW - 1)
    return (_slot(first) != _slot(last)) & F.forall(F.slice("w", i + 2, WINDOW - 2), _slot)


def mark_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs``, ``contaminated`` and ``item_ids`` (sorted, empty if clean); columns so named are replaced.

    Every row stays, whatever is null in it; see find_leaks() for what counts.
    """
    docs = docs.drop("contaminated", "item_ids")
    id_, items_ = free([*docs.columns, "contaminated", "item_ids"], "id", "items")
    leaks = find_leaks(docs, benchmark).groupBy(F.col("doc_id").alias(id_)).agg(F.sort_array(F.collect_set("item_id")).alias(items_))
    out = docs.join(leaks, docs["doc_id"].eqNullSafe(leaks[id_]), "left")
    return out.select(*[docs[c] for c in docs.columns], F.col(items_).isNotNull().alias("contaminated"), F.coalesce(items_, F.array().cast("array<bigint>")).alias("item_ids"))
