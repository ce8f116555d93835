"""Editing sessions: an ordered log of writes and entry operations folded into pages, sizes and the name overlay.

Where only writes occur, journal.live_pages() and its kin give the answer as
plain aggregates. Renames, removals and resizes make later rows depend on
earlier ones; then one archive's log is folded in order, archives in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quireflow import schemas
from quireflow.functions.geometry import PAGE_SIZE, touched


class EntryError(ValueError):
    """Why an operation on an entry is refused: NotFound, Exists or Unsupported."""

    def __init__(self, status: str, name: str = "") -> None:
        super().__init__(f"{status}: {name}")
        self.status = status


@dataclass(eq=False)
class Dirty:
    """An edited entry: its size now, and how far its source's bytes still count."""

    name: str
    logical: int
    source_size: int
    pages: dict[int, list] = field(default_factory=dict)  # page -> [stamp, bytes of a full page]
    spilled: dict[int, tuple] = field(default_factory=dict)  # page -> (where the second tier has it, how many of its bytes count)


class MemoryTier:
    """A second tier that is none: pages stay where they are."""

    def put(self, name: str, page: int, data: bytes):
        """Takes a page's bytes below the entry's size, and says where they are."""
        return data

    def get(self, place) -> bytes:
        return place


class Session:
    """The state of one archive under edit.

    ``sizes`` has the entries of the archive and whether their codec is known,
    ``source`` gives bytes of an entry as (name, offset, length). With a
    ``limit`` no more than so many bytes of pages are held; the pages first
    inserted go to ``tier``.
    """

    def __init__(self, sizes: dict[str, tuple[int, bool]], page_size: int = PAGE_SIZE, limit: int | None = None, source: Callable[[str, int, int], bytes] = lambda name, offset, length: b"", tier=None) -> None:
        self.sizes, self.page_size, self.limit, self.source, self.tier = sizes, page_size, limit, source, tier or MemoryTier()
        self.reset()

    def reset(self) -> None:
        """As after opening: no edit is left."""
        self.overlay: dict[str, tuple[str, str | None]] = {}
        self.dirty: dict[str, Dirty] = {}
        self.stamp = self.held = 0
        self._order: deque = deque()

    # names

    def kind(self, name: str) -> str:
        what = self.overlay.get(name, (None, None))[0]
        if what is None:
            return "Source" if name in self.sizes else "Absent"
        return {"Tombstone": "Absent", "Created": "Created", "Aliased": "Source"}[what]

    def source_of(self, name: str) -> str | None:
        """The archive entry whose bytes ``name`` has."""
        if self.kind(name) != "Source":
            return None
        return self.overlay.get(name, (None, name))[1] or name

    def original(self, name: str) -> int:
        source = self.source_of(name)
        return self.sizes[source][0] if source else 0

    def size(self, name: str) -> int:
        return self.dirty[name].logical if name in self.dirty else self.original(name)

    def names(self) -> list[str]:
        return [n for n in {**self.sizes, **self.overlay} if self.kind(n) != "Absent"]

    def is_dirty(self) -> bool:
        return bool(self.dirty or self.overlay)

    # operations

    def _need(self, name: str, supported: bool = False) -> None:
        if self.kind(name) == "Absent":
            raise EntryError("NotFound", name)
        source = self.source_of(name)
        if supported and source and not self.sizes[source][1]:
            raise EntryError("Unsupported", name)

    def _touch(self, name: str) -> Dirty:
        if name not in self.dirty:
            base = self.original(name)
            self.dirty[name] = Dirty(name, base, base)
        return self.dirty[name]

    def create(self, name: str) -> None:
        if self.kind(name) != "Absent":
            raise EntryError("Exists", name)
        self.overlay[name] = ("Created", None)
        self.dirty[name] = Dirty(name, 0, 0)

    def remove(self, name: str) -> None:
        self._need(name)
        self.overlay[name] = ("Tombstone", None)
        if name in self.dirty:
            self._forget(self.dirty.pop(name), lambda page: False)

    def rename(self, old: str, new: str) -> None:
        """The new name inherits what the old one is: created stays created, anything else points at its archive entry."""
        self._need(old)
        if self.kind(new) != "Absent":
            raise EntryError("Exists", new)
        source = self.source_of(old)
        self.overlay[new] = ("Aliased", source) if source else ("Created", None)
        self.overlay[old] = ("Tombstone", None)
        if old in self.dirty:
            self.dirty[new] = self.dirty.pop(old)
            self.dirty[new].name = new

    def truncate(self, name: str, size: int) -> None:
        """Shrinking drops pages, zeroes the boundary page's tail and lowers the source's high-water mark; growing reads as zeros."""
        self._need(name, supported=True)
        d = self._touch(name)
        if size < d.logical:
            d.source_size = min(d.source_size, size)
            keep = -(-size // self.page_size)
            self._forget(d, lambda page: page < keep)
            at = size - (keep - 1) * self.page_size
            if keep - 1 in d.pages:
                d.pages[keep - 1][1][at:] = bytes(self.page_size - at)
            if keep - 1 in d.spilled:
                place, counts = d.spilled[keep - 1]
                d.spilled[keep - 1] = (place, min(counts, at))
        d.logical = size

    def _forget(self, d: Dirty, keeps: Callable[[int], bool]) -> None:
        kept = {p: v for p, v in d.pages.items() if keeps(p)}
        self.held -= len(d.pages) - len(kept)
        d.pages, d.spilled = kept, {p: v for p, v in d.spilled.items() if keeps(p)}

    def write(self, name: str, offset: int, data: bytes) -> None:
        if not data:
            return
        self._need(name, supported=True)
        d, ps = self._touch(name), self.page_size
        end = offset + len(data)
        d.logical = max(d.logical, end)
        for p in range(offset // ps, (end - 1) // ps + 1):
            lo, hi = max(offset, p * ps), min(end, (p + 1) * ps)
            piece = data[lo - offset : hi - offset]
            if p in d.spilled:
                # a page in the second tier gets a newer record there, it doesn't come back
                page = bytearray(self.page(name, p))
                page[lo - p * ps : hi - p * ps] = piece
                self._put(d, p, page)
                continue
            if p not in d.pages:
                d.pages[p] = [self.stamp, bytearray(self._source_page(name, d, p))]
                self._order.append((self.stamp, d, p))
                self.stamp, self.held = self.stamp + 1, self.held + 1
            d.pages[p][1][lo - p * ps : hi - p * ps] = piece
            self._spill()

    def _put(self, d: Dirty, page: int, data: bytes) -> None:
        data = bytes(data[: max(0, min(self.page_size, d.logical - page * self.page_size))])
        d.spilled[page] = (self.tier.put(d.name, page, data), len(data))

    def _spill(self) -> None:
        """While more is held than the limit, the pages first inserted go to the second tier."""
        while self.limit is not None and self.held > self.limit // self.page_size:
            stamp, d, p = self._order.popleft()
            if p in d.pages and d.pages[p][0] == stamp:
                self._put(d, p, d.pages.pop(p)[1])
                self.held -= 1

    def indexed_pages(self) -> list[tuple[str, int]]:
        """Which pages the second tier holds."""
        return sorted((d.name, p) for d in self.dirty.values() for p in d.spilled)

    def _source_page(self, name: str, d: Dirty, page: int) -> bytes:
        at, source = page * self.page_size, self.source_of(name)
        n = max(0, min(self.page_size, d.source_size - at))
        return (self.source(source, at, n) if source and n else b"").ljust(self.page_size, b"\0")

    def page(self, name: str, page: int) -> bytes:
        d = self.dirty[name]
        if page in d.pages:
            return bytes(d.pages[page][1])
        if page in d.spilled:
            place, counts = d.spilled[page]
            return self.tier.get(place)[:counts].ljust(self.page_size, b"\0")
        return self._source_page(name, d, page)

    def read(self, name: str, offset: int, length: int) -> bytes:
        """Clean entries refuse reads past their end; edited, created and renamed ones give what there is."""
        self._need(name, supported=True)
        size, ps = self.size(name), self.page_size
        if name not in self.dirty and name not in self.overlay:
            if offset + length > size:
                raise EntryError("OutOfRange", name)
            return self.source(name, offset, length)
        end = min(offset + length, size)
        if end <= offset:
            return b""
        d = self.dirty.get(name) or Dirty(name, size, size)
        held = self.dirty.get(name)
        out = b"".join(self.page(name, p) if held else self._source_page(name, d, p) for p in range(offset // ps, (end - 1) // ps + 1))
        at = offset - offset // ps * ps
        return out[at : at + end - offset]

    def summary(self) -> Iterator[dict]:
        """Operations and pages that lead from no edit to this state, as journal rows: names first, then sizes, then pages.

        Names move in an order in which each is free when it is taken; where
        they change places in a ring, one steps aside under a name of its own.
        Pages are read one at a time.
        """
        twin = Session(self.sizes, self.page_size)

        def op(what: str, entry: str, new_size: int | None = None, new_name: str | None = None) -> dict:
            twin.apply(what, entry, new_size=new_size or 0, new_name=new_name or "")
            return {"kind": "META", "op": what, "entry": entry, "new_size": new_size, "new_name": new_name}

        moves = {source: name for name, (kind, source) in self.overlay.items() if kind == "Aliased"}
        for name in self.overlay:
            if name in self.sizes and name not in moves:
                yield op("REMOVE", name)
        while moves:
            free = [s for s, name in moves.items() if twin.kind(name) == "Absent"]
            for s in free:
                yield op("RENAME", s, new_name=moves.pop(s))
            if not free:
                s = aside = next(iter(moves))
                while aside in self.sizes or aside in self.overlay or twin.kind(aside) != "Absent":
                    aside += "~"
                yield op("RENAME", s, new_name=aside)
                moves[aside] = moves.pop(s)
        for name, (kind, _) in self.overlay.items():
            if kind == "Created":
                yield op("CREATE", name)
        for name, d in self.dirty.items():
            if d.source_size < twin.original(name):
                yield op("RESIZE", name, new_size=d.source_size)
            if d.logical != twin.size(name) or not (name in twin.dirty or d.pages or d.spilled):
                yield op("RESIZE", name, new_size=d.logical)
            for p in sorted({*d.pages, *d.spilled}):
                yield {"kind": "DATA", "entry": name, "page_index": p, "data": self.page(name, p)[: max(0, min(self.page_size, d.logical - p * self.page_size))]}

    def content(self, name: str) -> bytes:
        n = self.size(name)
        return b"" if not n else self.read(name, 0, n)

    def apply(self, op: str, entry: str, offset: int = 0, data: bytes = b"", new_size: int = 0, new_name: str = "") -> None:
        if op == "WRITE":
            self.write(entry, offset, data)
        elif op == "CREATE":
            self.create(entry)
        elif op == "REMOVE":
            self.remove(entry)
        elif op == "RESIZE":
            self.truncate(entry, new_size)
        elif op == "RENAME":
            self.rename(entry, new_name)
        else:
            raise EntryError("UnknownOp", op)


_RESULT = "archive_id string, what string, name string, kind string, source string, logical_size bigint, source_size bigint, page_index bigint, stamp bigint, tier int, data binary, sequence bigint"
#: Rows of a result batch.
_ROWS = 4096


def _result_rows(s: Session) -> Iterator[dict]:
    for n, (k, src) in s.overlay.items():
        yield {"what": "overlay", "name": n, "kind": k, "source": src}
    for n, d in s.dirty.items():
        yield {"what": "entry", "name": n, "logical_size": d.logical, "source_size": d.source_size}
        for p, v in d.pages.items():
            yield {"what": "page", "name": n, "page_index": p, "stamp": v[0], "tier": 1, "data": bytes(v[1])}
        for p, (place, counts) in d.spilled.items():
            yield {"what": "page", "name": n, "page_index": p, "tier": 2, "data": s.tier.get(place)[:counts]}


def replay(ops: DataFrame, entries: DataFrame, page_size: int = PAGE_SIZE, limit: int | None = None) -> DataFrame:
    """Folds each archive's ops (schemas.OPS) over its entries (archive_id, name, content) in sequence order.

    Rows of four sorts, by ``what``: overlay, entry (sizes), page (tier 1 in
    memory, 2 in the journal) and refused (an operation that failed, its
    status in ``kind``). Ties of the sequence keep a fixed order. Archives
    without operations are left out before anything moves, and of contents
    only pages go along that some write of the archive touches. Archives are
    folded one after another in one pass over sorted rows; the largest need is
    one archive's names and dirty pages.
    """
    ops = ops.select(*[c.split()[0] for c in schemas.OPS.split(", ")])
    entries = entries.select("archive_id", "name", F.col("content").cast("binary").alias("content"))
    entries = entries.join(ops.select("archive_id").distinct(), "archive_id", "left_semi")
    none = {c: F.lit(None).cast(t) for c, t in (x.split() for x in schemas.OPS.split(", "))}
    size = F.octet_length("content").cast("long")

    def part(step: int, df: DataFrame, **own) -> DataFrame:
        return df.select(F.lit(step).alias("step"), *[own.get(c, v).alias(c) for c, v in none.items()])

    name = {"archive_id": F.col("archive_id"), "entry": F.col("name")}
    known = part(0, entries, **name, new_size=size)
    write = (F.col("op") == "WRITE") & (F.octet_length("data") > 0) & (F.col("offset") >= 0)
    wanted = ops.where(write).select("archive_id", F.explode(touched("offset", F.octet_length("data"), page_size)).alias("page")).distinct()
    pages = entries.where(size > 0).select("archive_id", "name", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / page_size).cast("long"))).alias("page"))
    pages = pages.select("archive_id", "name", "page", F.substring("content", (F.col("page") * page_size + 1).cast("int"), page_size).alias("piece")).join(wanted, ["archive_id", "page"], "left_semi")
    contents = part(1, pages, **name, sequence=F.col("page"), data=F.col("piece"))
    rows = known.union(contents).union(part(2, ops, **{c: F.col(c) for c in none}))
    # a plain archive_id may be how the inputs are dealt already; Spark then drops this shuffle, and merges the partitions of each input its own way
    rows = rows.repartition(F.xxhash64("archive_id")).sortWithinPartitions("archive_id", "step", "sequence", "op", "entry")

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(_RESULT))
    fields = ["step", *none]

    def folded(batches) -> Iterator[dict]:
        key, s, began = None, None, False
        for batch in batches:
            for step, archive, sequence, op, entry, offset, data, new_size, new_name in zip(*(batch.column(c).to_pylist() for c in fields)):
                if not began or archive != key:
                    if began:
                        yield from ({"archive_id": key} | r for r in _result_rows(s))
                    key, began, held = archive, True, {}
                    s = Session({}, page_size, limit, lambda n, at, k, held=held: held.get((n, at // page_size), b"")[:k])
                if step == 0:
                    s.sizes[entry] = (new_size or 0, new_size is not None)
                elif step == 1:
                    held[entry, sequence] = data
                else:
                    try:
                        s.apply(op, entry, offset or 0, data or b"", new_size or 0, new_name or "")
                    except EntryError as e:
                        yield {"archive_id": key, "what": "refused", "name": entry, "kind": e.status, "sequence": sequence}
        if began:
            yield from ({"archive_id": key} | r for r in _result_rows(s))

    def run(batches):
        out = []
        for row in folded(batches):
            out.append(row)
            if len(out) == _ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, _RESULT)
