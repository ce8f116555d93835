"""Column expressions over long arrays and texts that stay linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays are folded in stretches of this length, as each step of a fold copies what it has gathered.
STRETCH = 256
#: Characters of a chunk of text.
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of ``values`` (array<bigint>) what ``combine`` makes of 0 and all before it: sums, or with F.greatest the largest."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def along(items: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def walk(stretches: Column) -> Column:
        whole = F.transform(stretches, lambda s: F.aggregate(s, zero, lambda a, x: combine(a, x)))
        return F.flatten(F.zip_with(stretches, along(whole, zero), along))

    cut = let(values, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int")), lambda i: F.slice(all_, i * STRETCH + 1, STRETCH)))
    return F.when(F.size(values) > 0, let(cut, walk)).otherwise(none)


def chunks(text: Column) -> Column:
    """``text`` in pieces of CHUNK characters, so that parts() need not count from its start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, at: Column, n: Column) -> Column:
    """``n`` characters from position ``at`` (0-based) of a text given as chunks()."""
    first = F.floor(at / CHUNK).cast("int")
    last = F.floor((at + n - 1) / CHUNK).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(n > 0, F.substring(joined, (at % CHUNK + 1).cast("int"), n.cast("int"))).otherwise(F.lit(""))
