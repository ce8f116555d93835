"""Fixed byte layouts: seek index, journal and commit intent. All integers are little-endian."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

from quireflow.functions.codes import BLOCK_STATE, CHUNK_CRC, CHUNK_HEADER, OP_CODE, PROVIDER_CODE, RECORD_SIZE
from quireflow.functions.hashing import crc32c_of, name_hash_of

# fixed values: magics and versions of the formats
INDEX_MAGIC, INDEX_VERSION = b"VMIDX\0\0\0", 1
JOURNAL_MAGIC, JOURNAL_VERSION = b"VMDIRTY\0", 1
CHUNK_MAGIC, DATA_MAGIC, META_MAGIC, MARKER_MAGIC = 0xCC401D01, 0xD1A5EC0D, 0xD1A5EC1D, 0xC0FFEE42
INTENT_MAGIC, INTENT_VERSION = 0x564D4943, 2
INTENT_MODES = ("FULL", "INCREMENTAL")

_INDEX = struct.Struct("<8sHHIQQQQ20s4xQQQQQQI4x")
_ENTRY = struct.Struct("<QQHBBH2xQQQQQQQ8xI4x")
_CHUNK = struct.Struct("<IQB3xQQ")
_STATE = struct.Struct("<QQBBB5x")
_JOURNAL = struct.Struct("<8sHH16sQQ20sQI4xI4x")
_MARKER = struct.Struct("<I16sQQI")
_INTENT = struct.Struct("<IHHQ16sQ16sI")
_PROVIDER = {v: k for k, v in PROVIDER_CODE.items()}
_OP = {v: k for k, v in OP_CODE.items()}


class BadFormat(ValueError):
    """Bytes that are not the structure they should be; ``status`` names what is wrong."""

    def __init__(self, status: str) -> None:
        super().__init__(status)
        self.status = status


def _sealed(body: bytes, upto: int, layout: struct.Struct) -> bytes:
    """``body`` with the CRC-32C of its first ``upto`` bytes written after them."""
    return body[:upto] + struct.pack("<I", crc32c_of(body[:upto])) + body[upto + 4 : layout.size]


@dataclass
class IndexHeader:
    flags: int = 0
    page_size: int = 4096
    checkpoint_interval: int = 1 << 20
    source_file_size: int = 0
    source_inode: int = 0
    source_mtime_ns: int = 0
    source_cd_hash: bytes = bytes(20)
    entry_count: int = 0
    entry_table_offset: int = 0
    name_heap_offset: int = 0
    name_heap_size: int = 0
    advisory_offset: int = 0
    advisory_size: int = 0

    SIZE = 128

    def refreshed(self, size: int, inode: int, mtime_ns: int) -> IndexHeader:
        """The header with the archive's present stat, for an index that is valid but stale."""
        return replace(self, source_file_size=size, source_inode=inode, source_mtime_ns=mtime_ns)

    def encode(self) -> bytes:
        return _sealed(_INDEX.pack(INDEX_MAGIC, INDEX_VERSION, *self.__dict__.values(), 0), 120, _INDEX)

    @classmethod
    def decode(cls, b: bytes) -> IndexHeader:
        if len(b) < cls.SIZE:
            raise BadFormat("FileTooSmall")
        magic, version, *rest, crc = _INDEX.unpack_from(b)
        if magic != INDEX_MAGIC:
            raise BadFormat("BadMagic")
        if version != INDEX_VERSION:
            raise BadFormat("UnsupportedVersion")
        if crc != crc32c_of(b[:120]):
            raise BadFormat("HeaderCrcMismatch")
        return cls(*rest)


@dataclass
class IndexEntry:
    name_hash: int = 0
    name_offset: int = 0
    name_len: int = 0
    provider: str = "Store"
    entry_flags: int = 0
    method_code: int = 0
    local_header_offset: int = 0
    data_offset: int = 0
    compressed_size: int = 0
    uncompressed_size: int = 0
    chunk_head_offset: int = 0
    checkpoint_count: int = 0
    commit_count: int = 0

    SIZE = 96

    def encode(self) -> bytes:
        values = [PROVIDER_CODE[v] if k == "provider" else v for k, v in self.__dict__.items()]
        return _sealed(_ENTRY.pack(*values, 0), 88, _ENTRY)

    @classmethod
    def decode(cls, b: bytes) -> IndexEntry:
        *values, crc = _ENTRY.unpack_from(b)
        if crc != crc32c_of(b[:88]):
            raise BadFormat("RecordCrcMismatch")
        values[3] = _PROVIDER.get(values[3], "Unsupported")
        return cls(*values)


@dataclass
class Checkpoint:
    """A resume point; which fields count depends on the provider."""

    uncompressed_offset: int
    compressed_offset: int = 0
    bits: int = 0
    window: bytes = b""
    capacity: int = 0
    frame_offset: int = 0


def window_of(output: bytes) -> bytes:
    """The last 32 KiB of what was decoded, right-aligned."""
    return output[-32768:].rjust(32768, b"\0")


def _encode_checkpoint(provider: str, c: Checkpoint) -> bytes:
    if provider == "Deflate":
        return struct.pack("<QQB", c.compressed_offset, c.uncompressed_offset, c.bits) + window_of(c.window)
    if provider == "DeflateVmm":
        return struct.pack("<QQQ", c.compressed_offset, c.uncompressed_offset, c.capacity)
    return struct.pack("<QQ", c.frame_offset, c.uncompressed_offset)


def _decode_checkpoint(provider: str, b: bytes) -> Checkpoint:
    first, second = struct.unpack_from("<QQ", b)
    if provider == "Deflate":
        return Checkpoint(second, first, b[16], b[17:])
    if provider == "DeflateVmm":
        return Checkpoint(second, first, capacity=struct.unpack_from("<Q", b, 16)[0])
    return Checkpoint(second, frame_offset=first)


@dataclass
class Chunk:
    entry_index: int
    provider: str
    next_offset: int = 0
    checkpoints: list[Checkpoint] = field(default_factory=list)

    def encode(self) -> bytes:
        if self.provider not in RECORD_SIZE:
            raise BadFormat("ChunkNoCheckpointFormat")
        body = _CHUNK.pack(CHUNK_MAGIC, self.entry_index, PROVIDER_CODE[self.provider], len(self.checkpoints), self.next_offset)
        body += b"".join(_encode_checkpoint(self.provider, c) for c in self.checkpoints)
        return body + struct.pack("<I", crc32c_of(body))

    @classmethod
    def decode(cls, b: bytes) -> Chunk:
        """The chunk at the start of ``b``, which may go on: the length is in the header."""
        if len(b) < CHUNK_HEADER:
            raise BadFormat("ChunkTruncated")
        magic, entry, code, n, after = _CHUNK.unpack_from(b)
        if magic != CHUNK_MAGIC:
            raise BadFormat("ChunkBadMagic")
        provider = _PROVIDER.get(code, "Unsupported")
        if provider not in RECORD_SIZE:
            raise BadFormat("ChunkNoCheckpointFormat")
        size = RECORD_SIZE[provider]
        end = CHUNK_HEADER + n * size
        if len(b) < end + CHUNK_CRC:
            raise BadFormat("ChunkTruncated")
        if struct.unpack_from("<I", b, end)[0] != crc32c_of(b[:end]):
            raise BadFormat("ChunkCrcMismatch")
        return cls(entry, provider, after, [_decode_checkpoint(provider, b[at : at + size]) for at in range(CHUNK_HEADER, end, size)])


@dataclass
class Advisory:
    """Miss counters of the entries, and (entry, block, flags, overflows, shrink streak) of some blocks."""

    miss_count: list[int]
    block_state: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def encode(self) -> bytes:
        return struct.pack(f"<{len(self.miss_count)}QQ", *self.miss_count, len(self.block_state)) + b"".join(_STATE.pack(*s) for s in self.block_state)

    @classmethod
    def decode(cls, b: bytes, entries: int) -> Advisory:
        """A region that doesn't add up reads as all zero, never as an error."""
        if len(b) >= 8 * entries + 8:
            *misses, n = struct.unpack_from(f"<{entries}QQ", b)
            at = 8 * entries + 8
            if len(b) >= at + n * BLOCK_STATE:
                return cls(misses, [_STATE.unpack_from(b, at + i * BLOCK_STATE) for i in range(n)])
        return cls([0] * entries)


@dataclass
class IndexRow:
    """One entry to be indexed; hash, offsets and counts in ``record`` are set by build_index()."""

    name: str
    record: IndexEntry
    checkpoints: list[Checkpoint] = field(default_factory=list)


def build_index(header: IndexHeader, rows: list[IndexRow], block_state: list[tuple] = ()) -> bytes:
    """The whole index file: header, records by (name hash, name), name heap, advisory region, checkpoint chunks."""
    for r in rows:
        if len(r.name.encode()) > 0xFFFF:
            raise BadFormat("NameTooLong")
        r.record.name_hash = name_hash_of(r.name)
    rows = sorted(rows, key=lambda r: (r.record.name_hash, r.name.encode()))
    heap = bytearray()
    for r in rows:
        r.record.name_offset, r.record.name_len = len(heap), len(r.name.encode())
        heap += r.name.encode()
    header.entry_count = len(rows)
    header.entry_table_offset = IndexHeader.SIZE
    header.name_heap_offset = IndexHeader.SIZE + len(rows) * IndexEntry.SIZE
    header.name_heap_size = len(heap)
    header.advisory_offset = header.name_heap_offset + len(heap)
    advisory = Advisory([0] * len(rows), list(block_state)).encode()
    header.advisory_size = len(advisory)
    zone, chunks = header.advisory_offset + len(advisory), bytearray()
    for i, r in enumerate(rows):
        r.record.checkpoint_count = len(r.checkpoints)
        r.record.chunk_head_offset = zone + len(chunks) if r.checkpoints else 0
        if r.checkpoints:
            chunks += Chunk(i, r.record.provider, 0, r.checkpoints).encode()
    return header.encode() + b"".join(r.record.encode() for r in rows) + bytes(heap) + advisory + bytes(chunks)


class Index:
    """A view of an index file. Regions are checked at once, records and chunks when touched."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        h = self.header = IndexHeader.decode(data)
        ends = [h.entry_table_offset + h.entry_count * IndexEntry.SIZE, h.name_heap_offset + h.name_heap_size, h.advisory_offset + h.advisory_size]
        if max(ends) > len(data) or h.entry_table_offset < IndexHeader.SIZE:
            raise BadFormat("RegionOutOfBounds")

    def __len__(self) -> int:
        return self.header.entry_count

    def entry(self, i: int) -> IndexEntry:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = self.header.entry_table_offset + i * IndexEntry.SIZE
        return IndexEntry.decode(self.data[at : at + IndexEntry.SIZE])

    def name(self, e: IndexEntry) -> str | None:
        """None outside the heap or if it isn't UTF-8."""
        if e.name_offset + e.name_len > self.header.name_heap_size:
            return None
        at = self.header.name_heap_offset + e.name_offset
        try:
            return self.data[at : at + e.name_len].decode()
        except UnicodeDecodeError:
            return None

    def lookup(self, name: str) -> tuple[int, IndexEntry] | None:
        """Binary search by hash, then the run of equal hashes by name."""
        from bisect import bisect_left

        want = name_hash_of(name)
        at = self.header.entry_table_offset
        i = bisect_left(range(len(self)), want, key=lambda i: struct.unpack_from("<Q", self.data, at + i * IndexEntry.SIZE)[0])
        while i < len(self) and (e := self.entry(i)).name_hash == want:
            if self.name(e) == name:
                return i, e
            i += 1
        return None

    def chunks(self, e: IndexEntry) -> list[Chunk]:
        out, at, seen = [], e.chunk_head_offset, set()
        while at:
            if at in seen:
                raise BadFormat("ChunkChainCycle")
            seen.add(at)
            if at >= len(self.data):
                raise BadFormat("ChunkTruncated")
            out.append(Chunk.decode(self.data[at:]))
            at = out[-1].next_offset
        return out

    def nearest_checkpoint(self, e: IndexEntry, target: int) -> Checkpoint | None:
        """The last checkpoint at or before ``target`` over all chunks; of equal ones that of the later chunk."""
        best = None
        for chunk in self.chunks(e):
            for c in chunk.checkpoints:
                if c.uncompressed_offset <= target and (best is None or c.uncompressed_offset >= best.uncompressed_offset):
                    best = c
        return best

    def advisory(self) -> Advisory:
        h = self.header
        return Advisory.decode(self.data[h.advisory_offset : h.advisory_offset + h.advisory_size], len(self))


@dataclass
class JournalHeader:
    flags: int = 0
    generation_id: bytes = bytes(16)
    source_file_size: int = 0
    source_inode: int = 0
    source_cd_hash: bytes = bytes(20)
    created_at_ns: int = 0
    page_size: int = 4096

    SIZE = 88

    def encode(self) -> bytes:
        return _sealed(_JOURNAL.pack(JOURNAL_MAGIC, JOURNAL_VERSION, *self.__dict__.values(), 0), 80, _JOURNAL)

    @classmethod
    def decode(cls, b: bytes) -> JournalHeader:
        if len(b) < cls.SIZE:
            raise BadFormat("HeaderTruncated")
        magic, version, *rest, crc = _JOURNAL.unpack_from(b)
        if magic != JOURNAL_MAGIC:
            raise BadFormat("HeaderMagicBad")
        if crc != crc32c_of(b[:80]):
            raise BadFormat("HeaderCrcBad")
        if version > JOURNAL_VERSION:
            raise BadFormat("VersionUnsupported")
        return cls(*rest)


def _record(body: bytes) -> bytes:
    return body + struct.pack("<I", crc32c_of(body))


def encode_data(generation: bytes, sequence: int, name: str, page: int, data: bytes) -> bytes:
    raw = name.encode()
    return _record(struct.pack("<I16sQH", DATA_MAGIC, generation, sequence, len(raw)) + raw + struct.pack("<QI", page, len(data)) + data)


def encode_meta(generation: bytes, sequence: int, name: str, op: str, new_size: int = 0, new_name: str = "") -> bytes:
    raw, target = name.encode(), new_name.encode()
    payload = struct.pack("<Q", new_size) if op == "RESIZE" else struct.pack("<H", len(target)) + target if op == "RENAME" else b""
    return _record(struct.pack("<I16sQHH", META_MAGIC, generation, sequence, OP_CODE[op], len(raw)) + raw + payload)


def encode_marker(generation: bytes, commit_sequence: int, page_count: int) -> bytes:
    return _record(struct.pack("<I16sQQ", MARKER_MAGIC, generation, commit_sequence, page_count))


def walk_journal(b: bytes) -> tuple[JournalHeader, list[dict], int | None]:
    """Header, records in file order, and where the walk stopped (None at a clean end).

    The walk ends at the first record that is torn, of another generation, of
    an unknown kind, longer than a page, or fails its CRC. Raises BadFormat if
    the header can't be read.
    """
    header = JournalHeader.decode(b)
    rows: list[dict] = []
    at = JournalHeader.SIZE
    while at < len(b):
        row = _journal_record(b, at, header)
        if row is None:
            return header, rows, at
        at = row.pop("end")
        rows.append(row)
    return header, rows, None


def _journal_record(b: bytes, at: int, header: JournalHeader) -> dict | None:
    base = {"file_offset": at, "generation_id": header.generation_id, "kind": None, "sequence": None, "entry": None, "page_index": None, "data": None, "op": None, "new_size": None, "new_name": None, "commit_sequence": None, "page_count": None}
    try:
        magic, generation, number = struct.unpack_from("<I16sQ", b, at)
        if generation != header.generation_id:
            return None
        at2 = at + 28
        if magic == DATA_MAGIC:
            (n,) = struct.unpack_from("<H", b, at2)
            name = b[at2 + 2 : at2 + 2 + n]
            page, size = struct.unpack_from("<QI", b, at2 + 2 + n)
            if size > header.page_size:
                return None
            end = at2 + 14 + n + size
            base |= {"kind": "DATA", "sequence": number, "entry": name.decode(errors="replace"), "page_index": page, "data": b[end - size : end]}
        elif magic == META_MAGIC:
            code, n = struct.unpack_from("<HH", b, at2)
            if code not in _OP:
                return None
            name, end = b[at2 + 4 : at2 + 4 + n], at2 + 4 + n
            base |= {"kind": "META", "sequence": number, "entry": name.decode(errors="replace"), "op": _OP[code]}
            if _OP[code] == "RESIZE":
                base["new_size"] = struct.unpack_from("<Q", b, end)[0]
                end += 8
            elif _OP[code] == "RENAME":
                (m,) = struct.unpack_from("<H", b, end)
                base["new_name"] = b[end + 2 : end + 2 + m].decode(errors="replace")
                end += 2 + m
        elif magic == MARKER_MAGIC:
            base |= {"kind": "COMMIT", "commit_sequence": number, "page_count": struct.unpack_from("<Q", b, at2)[0]}
            end = at2 + 8
        else:
            return None
        if struct.unpack_from("<I", b, end)[0] != crc32c_of(b[at:end]):
            return None
        return base | {"end": end + 4}
    except struct.error:
        return None


@dataclass
class Intent:
    """What the archive was before a commit and is to be after it."""

    mode: str
    pre_size: int
    pre_cd_hash: bytes
    post_size: int
    post_cd_hash: bytes

    def encode(self) -> bytes:
        return _record(_INTENT.pack(INTENT_MAGIC, INTENT_VERSION, INTENT_MODES.index(self.mode), self.pre_size, self.pre_cd_hash, self.post_size, self.post_cd_hash, 0)[:56])

    @classmethod
    def decode(cls, b: bytes | None) -> Intent | None:
        """None if missing, torn, of another version or damaged."""
        if b is None or len(b) != _INTENT.size:
            return None
        magic, version, mode, *rest, crc = _INTENT.unpack(b)
        if magic != INTENT_MAGIC or version != INTENT_VERSION or mode >= len(INTENT_MODES) or crc != crc32c_of(b[:56]):
            return None
        return cls(INTENT_MODES[mode], *rest)

    def state(self, size: int, cd_hash: bytes | None) -> str:
        """``post``, ``pre`` or ``neither``, by the archive's present size and directory hash."""
        if (size, cd_hash) == (self.post_size, self.post_cd_hash):
            return "post"
        return "pre" if (size, cd_hash) == (self.pre_size, self.pre_cd_hash) else "neither"
