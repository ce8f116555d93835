"""Page-cache simulation: least recently used, bounded by bytes, with read-ahead."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


class PageCache:
    """Pages by key, least recently used first; bounded by bytes, but the last page is never evicted."""

    def __init__(self, most_bytes: int) -> None:
        self.most = most_bytes
        self.held: OrderedDict = OrderedDict()
        self.bytes = self.hits = self.misses = 0

    def __contains__(self, key) -> bool:
        """Changes neither order nor counters."""
        return key in self.held

    def __len__(self) -> int:
        return len(self.held)

    def get(self, key):
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][0]
        self.misses += 1
        return None

    def insert(self, key, data, size: int | None = None) -> None:
        size = len(data) if size is None else size
        if key in self.held:
            self.bytes -= self.held.pop(key)[1]
        self.held[key] = (data, size)
        self.bytes += size
        while self.bytes > self.most and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][1]

    def clear(self) -> None:
        """Drops the pages, keeps the counters."""
        self.held.clear()
        self.bytes = 0


def fill_run(cache: PageCache, entry, target: int, total: int, ahead: int) -> list[int]:
    """The pages one miss decodes: the target and those after it, up to the first already held."""
    run = [target]
    while len(run) <= ahead and run[-1] + 1 < total and (entry, run[-1] + 1) not in cache:
        run.append(run[-1] + 1)
    return run


def read_cached(cache: PageCache, entry, offset: int, length: int, size: int, page_size: int, ahead: int, decode: Callable[[int, int], bytes], on_miss: Callable[[], None] = lambda: None) -> bytes:
    """Bytes of an entry through the cache; ``on_miss`` runs before the source is touched and may refuse by raising.

    One miss decodes its whole run at once. Bytes are handed on from what was
    decoded, so a cache of any size will do.
    """
    total, out, fresh = -(-size // page_size), [], {}
    for page in range(offset // page_size, -(-(offset + length) // page_size) if length else 0):
        data = fresh.pop(page, None)
        if data is None:
            data = cache.get((entry, page))
        if data is None:
            on_miss()
            run = fill_run(cache, entry, page, total, ahead)
            raw = decode(page * page_size, min(size, (run[-1] + 1) * page_size) - page * page_size)
            fresh = {p: raw[(p - page) * page_size : (p - page + 1) * page_size] for p in run}
            for p, piece in fresh.items():
                cache.insert((entry, p), piece)
            data = fresh.pop(page)
        start = page * page_size
        out.append(data[max(0, offset - start) : offset + length - start])
    return b"".join(out)


def simulate(accesses: DataFrame, by: str, order: str, entry: str, page: str, total: int, page_bytes: int, cache_bytes: int, ahead: int = 0) -> DataFrame:
    """hits, misses, resident and resident_bytes of each session's accesses replayed in order.

    Sessions lie side by side in sorted partitions and are replayed one after
    another in one pass; of a session no more than its cache is held.
    """
    kind = dict(accesses.dtypes)[by]
    schema = f"{by} {kind}, hits bigint, misses bigint, resident bigint, resident_bytes bigint"
    rows = accesses.select(by, order, entry, page).repartition(by).sortWithinPartitions(by, order, entry, page)

    def run(batches):
        out: list[tuple] = []
        cache, key, began, field = None, None, False, None

        def done() -> pa.RecordBatch:
            keys, *rest = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(keys, field), *(pa.array(x, pa.int64()) for x in rest)], names=[by, "hits", "misses", "resident", "resident_bytes"])

        for batch in batches:
            field = batch.schema.field(0).type
            for k, e, p in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if not began or k != key:
                    if began:
                        out.append((key, cache.hits, cache.misses, len(cache), cache.bytes))
                    cache, key, began = PageCache(cache_bytes), k, True
                if cache.get((e, p)) is None:
                    for q in fill_run(cache, e, p, total, ahead):
                        cache.insert((e, q), b"", page_bytes)
            if len(out) > 4096:
                yield done()
                out = []
        if began:
            out.append((key, cache.hits, cache.misses, len(cache), cache.bytes))
        if out:
            yield done()

    return rows.mapInArrow(run, schema)
