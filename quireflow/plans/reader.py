"""Random reads of one archive's entries: through the seek index, its checkpoints and a page cache."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quireflow.functions import codecs as C
from quireflow.functions.codes import METHOD_PROVIDER
from quireflow.functions.deflate import CODECS, INTERVAL, read_range
from quireflow.functions.geometry import CACHE_BYTES, PAGE_SIZE, READ_AHEAD
from quireflow.functions.hashing import cd_hash_of
from quireflow.operators.cache import PageCache, read_cached
from quireflow.operators.session import EntryError
from quireflow.sources import zip_format as Z


@dataclass(frozen=True)
class Stat:
    size: int
    inode: int
    mtime_ns: int


def build_index(data, directory: Z.Directory, stat: Stat, page_size: int = PAGE_SIZE, interval: int | None = None) -> bytes:
    """The archive's seek index: one record an entry, and with an ``interval`` the entries' checkpoints.

    A name that isn't UTF-8, and with an interval one entry that doesn't
    decode, fails the build.
    """
    rows = []
    for e in directory.entries:
        if e.name is None:
            raise Z.ZipError("NonUtf8Name")
        start = Z.data_offset(data, e)
        record = C.IndexEntry(
            provider=METHOD_PROVIDER.get(e.method_code, "Unsupported"), method_code=e.method_code, local_header_offset=e.local_header_offset, data_offset=start, compressed_size=e.compressed_size, uncompressed_size=e.uncompressed_size
        )
        points = CODECS[e.method_code].checkpoints(Z.payload(data, e), e.uncompressed_size, interval) if interval and e.method_code in CODECS else []
        rows.append(C.IndexRow(e.name, record, points))
    header = C.IndexHeader(page_size=page_size, checkpoint_interval=interval or INTERVAL, source_file_size=stat.size, source_inode=stat.inode, source_mtime_ns=stat.mtime_ns, source_cd_hash=cd_hash_of(Z.directory_block(data, directory)) + bytes(4))
    return C.build_index(header, rows)


class Reader:
    """The unedited entries of an archive given as bytes, or as anything that is sliced like them."""

    def __init__(self, data, directory: Z.Directory, index: C.Index, page_size: int = PAGE_SIZE, read_ahead: int = READ_AHEAD, cache_bytes: int = CACHE_BYTES) -> None:
        self.data, self.index, self.page_size, self.read_ahead = data, index, page_size, read_ahead
        self.entries = {e.name: e for e in directory.entries}
        self.cache = PageCache(cache_bytes)
        self.sizes = {e.name: (e.uncompressed_size, e.method_code in CODECS) for e in directory.entries}

    def decode(self, name: str, offset: int, length: int) -> bytes:
        """Past the cache: looked up in the index, and decoded from the last checkpoint before ``offset``."""
        found = self.index.lookup(name)
        if found is None:
            raise EntryError("NotFound", name)
        record = found[1]
        point = self.index.nearest_checkpoint(record, offset)
        payload = Z.payload(self.data, self.entries[name])
        return read_range(record.method_code, payload, offset, length, record.uncompressed_size, [point] if point else [])

    def read(self, name: str, offset: int, length: int, on_miss: Callable[[], None] = lambda: None) -> bytes:
        """Through the cache; a read past the entry's end fails."""
        size = self.entries[name].uncompressed_size
        if offset + length > size:
            raise EntryError("OutOfRange", name)
        return read_cached(self.cache, name, offset, length, size, self.page_size, self.read_ahead, lambda at, n: self.decode(name, at, n), on_miss)
