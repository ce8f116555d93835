"""Secret scanning behind a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean query over the trigrams any
match must hold. The index is a table of its own, sorted by trigram: one
posting for each document and each trigram that some query mentions. Postings
are intersected per document, and only documents that satisfy a rule's query
are matched against its expression. Rules without a mandatory trigram scan
every text. Texts are read twice, once for the index and once to be matched,
and moved only if the candidates are too many to be sent to where the texts are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm import trigrams
from quireflow.llm.columns import chunks, let, part, running
from quireflow.llm.names import free
from quireflow.llm.scratch import Scratch

#: So many candidates (an id and a few flags each, some 60 bytes in a hash table) go to the texts by broadcast; more are joined by exchange.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    The pattern must mean the same in Java and Python syntax; no match may be empty.
    """

    kind: str
    pattern: str
    group: int
    least: int


# fixed values: the base rules
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def grams_of(rules: tuple[Rule, ...]) -> list[str]:
    """Every trigram that some rule's query mentions."""
    return sorted({g for r in rules for clause in trigrams.query(r.pattern) for g in trigrams.grams(clause)})


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): one row for each text and each of ``grams`` found in it, case folded."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.explode(held).alias("gram"), "doc_id").sortWithinPartitions("gram")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, list[int | None]]:
    """Documents whose postings satisfy some rule's query, as (doc_id, one flag a rule), and which flag each rule has.

    ``index`` is postings() of at least grams_of(rules).
    """
    queries, grams = [trigrams.query(r.pattern) for r in rules], grams_of(rules)
    if not grams:
        return None, [None] * len(rules)
    at = {g: i for i, g in enumerate(grams)}
    lanes = range(-(-len(grams) // 62))
    number = F.create_map(*[x for g, i in at.items() for x in (F.lit(g), F.lit(i))])
    found = index.where(F.col("gram").isin(grams)).select("doc_id", number[F.col("gram")].alias("gram"))
    # intersecting postings: the grams of a document as bits, 62 in a lane
    merged = found.groupBy("doc_id").agg(*[F.expr(f"bit_or(CASE WHEN gram BETWEEN {62 * k} AND {62 * k + 61} THEN shiftleft(1L, gram - {62 * k}) ELSE 0L END)").alias(f"lane{k}") for k in lanes])

    def all_of(conjunction) -> Column:
        out = F.lit(True)
        for k in lanes:
            if mask := sum(1 << (at[g] - 62 * k) for g in conjunction if at[g] // 62 == k):
                out = out & (F.col(f"lane{k}").bitwiseAND(F.lit(mask).cast("long")) == mask)
        return out

    flags, place = [], []
    for q in queries:
        if not q:
            place.append(None)
            continue
        ok = F.lit(True)
        for clause in q:
            one = F.lit(False)
            for conjunction in sorted(clause, key=sorted):
                one = one | all_of(conjunction)
            ok = ok & one
        place.append(len(flags))
        flags.append(ok.alias(f"flag{len(flags)}"))
    merged = merged.select(F.col("doc_id"), *flags)
    return merged.where(" OR ".join(f"flag{i}" for i in range(len(flags)))), place


def _quick(rule: Rule) -> str:
    """An expression that finds something if ``rule`` does, cheap to test where nothing is found."""
    if rule.group == 0 and rule.pattern.endswith("+") and rule.pattern.startswith("[") and rule.pattern.count("[") == 1:
        return f"{rule.pattern[:-1]}{{{rule.least}}}"
    return rule.pattern


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """[(start, order, end)] of a rule in one text, by the lengths of what lies between matches."""
    rx = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"), F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("part"))
    sizes = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["part"]).alias("part")))

    def placed(each: Column) -> Column:
        before = running(F.transform(each, lambda x: (x["gap"] + x["hit"]).cast("long")))
        spans = F.zip_with(each, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("kind"), (at + x["gap"] + x["hit"]).alias("end"), x["part"].alias("part")))
        return F.transform(F.filter(spans, lambda x: x["part"] >= rule.least), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return F.when(text.rlike(_quick(rule)), let(sizes, placed)).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``secrets``: [(start, kind, end)] sorted by start, then by rule.

    Positions count code points, the end is exclusive; ``kind`` is the rule's
    place in ``rules``. Null or empty text has none. A null doc_id matches
    null ids; rows that repeat an id are each matched on their own text. A
    column named secrets is replaced, others are carried along whatever their
    names. An empty table gives an empty one. ``index`` may be postings() kept
    from an earlier call on the same documents.
    """
    docs = docs.drop("secrets")
    scratch = Scratch(docs.sparkSession, "secrets", docs)
    plain = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if index is None and grams_of(rules):
        index = scratch.keep(postings(plain, grams_of(rules)))
    chosen, place = candidates(index, rules)
    joined, flags = docs, []
    if chosen is not None:
        chosen = scratch.keep(chosen)
        id_, *flags = free([*docs.columns, "secrets"], "id", *chosen.columns[1:])
        small = chosen.count() <= BROADCAST_ROWS
        chosen = chosen.toDF(id_, *flags)
        joined = docs.join(F.broadcast(chosen) if small else chosen, docs["doc_id"].eqNullSafe(chosen[id_]), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = [_spans(text, r, i) if place[i] is None else F.when(F.col(flags[place[i]]), _spans(text, r, i)).otherwise(empty) for i, r in enumerate(rules)]
    return joined.select(*[docs[c] for c in docs.columns], F.array_sort(F.concat(*found)).alias("secrets"))


def joined_spans(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``; ``spans`` are sorted by start."""

    def done(pieces: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)  # where what is hidden before each span ends
        fresh = F.filter(F.zip_with(spans, ends, lambda s, at: F.struct(s["start"].alias("start"), at.alias("at"))), lambda s: s["start"] >= s["at"])
        kept = F.transform(fresh, lambda s: F.concat(part(pieces, s["at"], s["start"] - s["at"]), F.lit(mark)))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(kept, ""), part(pieces, last, F.length(text) - last))

    return F.when(F.size(spans) > 0, let(chunks(text), done)).otherwise(text)
