"""ZIP structures: finding and reading a central directory, and writing archives."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, replace

from quireflow.functions.codes import MAX_32
from quireflow.functions.deflate import deflate_of

_EOCD = struct.Struct("<4s4H2IH")
_CD = struct.Struct("<4s6H3I5H2I")
_LFH = struct.Struct("<4s5H3I2H")
_ZIP64_LOCATOR = struct.Struct("<4sIQI")
_ZIP64_EOCD = struct.Struct("<4sQ2H2I4Q")
DATA_DESCRIPTOR = 0x8


class ZipError(ValueError):
    """Why an archive or entry can't be read; ``status`` names it."""

    def __init__(self, status: str) -> None:
        super().__init__(status)
        self.status = status


@dataclass(frozen=True)
class Entry:
    """One row of a central directory."""

    cd_ordinal: int
    name_bytes: bytes
    method_code: int
    flags: int
    crc32: int
    compressed_size: int
    uncompressed_size: int
    local_header_offset: int
    cd_record: bytes

    @property
    def name(self) -> str | None:
        """None if it isn't UTF-8."""
        try:
            return self.name_bytes.decode()
        except UnicodeDecodeError:
            return None

    @property
    def zip64_offset(self) -> bool:
        """Whether the record holds its offset in a Zip64 field, so that it can't be patched in place."""
        return struct.unpack_from("<I", self.cd_record, 42)[0] == MAX_32


@dataclass(frozen=True)
class Directory:
    entries: list[Entry]
    cd_offset: int
    cd_size: int
    file_size: int

    def bloat(self) -> dict:
        """Live bytes are compressed entries, the directory and what follows it; an archive without any has ratio 1."""
        live = sum(e.compressed_size for e in self.entries) + self.cd_size + self.file_size - (self.cd_offset + self.cd_size)
        return {"file_size": self.file_size, "live_bytes": live, "bloat_bytes": max(0, self.file_size - live), "bloat_ratio": self.file_size / live if live else 1.0}


def _field(layout: struct.Struct, data, at: int) -> tuple:
    """One structure at an offset of ``data``, of which only slices are taken."""
    raw = data[at : at + layout.size]
    if len(raw) < layout.size:
        raise ZipError("Truncated")
    return layout.unpack(raw)


def find_end(data) -> int:
    """Offset of the end record: the last whose comment reaches exactly to the end of the file."""
    base = max(0, len(data) - _EOCD.size - 0xFFFF)
    tail = bytes(data[base:])
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at + 3 if at < len(tail) else at)) >= 0:
        if at + _EOCD.size <= len(tail) and at + _EOCD.size + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            return base + at
    raise ZipError("EocdNotFound")


def _zip64(extra: bytes, values: list[int], sentinels: list[bool]) -> list[int]:
    """Values whose 32-bit field is a sentinel, from extra field 1, in their fixed order."""
    if not any(sentinels):
        return values
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            body, out, pos = extra[at + 4 : at + 4 + size], [], 0
            for v, wanted in zip(values, sentinels):
                if wanted:
                    if pos + 8 > len(body):
                        raise ZipError("Truncated")
                    v, pos = struct.unpack_from("<Q", body, pos)[0], pos + 8
                out.append(v)
            return out
        at += 4 + size
    raise ZipError("Truncated")


def read_directory(data: bytes) -> Directory:
    """All rows of the central directory, in its order."""
    end = find_end(data)
    _, disk, cd_disk, here, total, size, offset, _ = _field(_EOCD, data, end)
    if 0xFFFF in (disk, cd_disk, here, total) or MAX_32 in (size, offset):
        at = end - _ZIP64_LOCATOR.size
        if at < 0 or data[at : at + 4] != b"PK\6\7":
            raise ZipError("Zip64LocatorNotFound")
        at = _field(_ZIP64_LOCATOR, data, at)[2]
        if at + _ZIP64_EOCD.size > len(data) or data[at : at + 4] != b"PK\6\6":
            raise ZipError("Truncated")
        total, size, offset = _field(_ZIP64_EOCD, data, at)[7:10]
    elif disk or cd_disk or here != total:
        raise ZipError("MultiDisk")
    if offset + size > len(data):
        raise ZipError("Truncated")
    entries, at, block = [], 0, bytes(data[offset : offset + size])
    for i in range(total):
        if at + _CD.size > size:
            raise ZipError("Truncated")
        magic, _, _, flags, method, _, _, crc, packed, plain, n, m, k, _, _, _, lho = _CD.unpack_from(block, at)
        if magic != b"PK\1\2":
            raise ZipError("BadCdSignature")
        stop = at + _CD.size + n + m + k
        if stop > size:
            raise ZipError("Truncated")
        extra = block[at + _CD.size + n : at + _CD.size + n + m]
        plain, packed, lho = _zip64(extra, [plain, packed, lho], [plain == MAX_32, packed == MAX_32, lho == MAX_32])
        entries.append(Entry(i, block[at + _CD.size : at + _CD.size + n], method, flags, crc, packed, plain, lho, block[at:stop]))
        at = stop
    return Directory(entries, offset, size, len(data))


def data_offset(data: bytes, entry: Entry) -> int:
    """Where the entry's data starts: its local header decides, whose extra field may differ from the directory's."""
    at = entry.local_header_offset
    head = bytes(data[at : at + _LFH.size])
    if len(head) < _LFH.size:
        raise ZipError("Truncated")
    if head[:4] != b"PK\3\4":
        raise ZipError("BadLfhSignature")
    n, m = struct.unpack_from("<HH", head, 26)
    return at + _LFH.size + n + m


def payload(data: bytes, entry: Entry) -> bytes:
    at = data_offset(data, entry)
    if at + entry.compressed_size > len(data):
        raise ZipError("Truncated")
    return data[at : at + entry.compressed_size]


def directory_block(data: bytes, d: Directory) -> bytes:
    """The bytes an archive's fingerprint hashes."""
    return data[d.cd_offset : d.cd_offset + d.cd_size]


@dataclass(frozen=True)
class NewEntry:
    """An entry to be written anew: plain content, stored or deflated."""

    name_bytes: bytes
    method_code: int
    content: bytes


class Writer:
    """Builds archive bytes after ``base`` bytes that stay as they are."""

    def __init__(self, base: int = 0) -> None:
        self.base = base
        self.body = bytearray()
        self.records: list[tuple[int, bytes]] = []

    def add(self, new: NewEntry) -> None:
        packed = deflate_of(new.content)[0] if new.method_code == 8 else new.content
        lho = self.base + len(self.body)
        if max(lho, len(packed), len(new.content)) > MAX_32 or len(new.name_bytes) > 0xFFFF:
            raise ZipError("TooLarge")
        fixed = (20, 0, new.method_code, 0, 0, zlib.crc32(new.content), len(packed), len(new.content), len(new.name_bytes))
        self.body += _LFH.pack(b"PK\3\4", *fixed, 0) + new.name_bytes + packed
        self.records.append((lho, _CD.pack(b"PK\1\2", 20, *fixed, 0, 0, 0, 0, 0, 0) + new.name_bytes))

    def copy(self, data: bytes, entry: Entry) -> None:
        """An unmodified entry, byte for byte; one with a data descriptor is written anew, as what follows its data isn't known."""
        if entry.flags & DATA_DESCRIPTOR:
            raise ZipError("DataDescriptor")
        self._can_patch(entry)
        lho = self.base + len(self.body)
        if lho > MAX_32:
            raise ZipError("TooLarge")
        self.body += data[entry.local_header_offset : data_offset(data, entry) + entry.compressed_size]
        self.records.append((lho, entry.cd_record))

    def keep(self, entry: Entry) -> None:
        """An unmodified entry that stays where it is."""
        self._can_patch(entry)
        self.records.append((entry.local_header_offset, entry.cd_record))

    @staticmethod
    def _can_patch(entry: Entry) -> None:
        if entry.zip64_offset:
            raise ZipError("Zip64Offset")

    def finish(self) -> bytes:
        """Body, central directory (only offsets patched) and end record; no archive comment, no Zip64."""
        cd = b"".join(r[:42] + struct.pack("<I", lho) + r[46:] for lho, r in self.records)
        at = self.base + len(self.body)
        if len(self.records) >= 0xFFFF or max(at, len(cd)) >= MAX_32:
            raise ZipError("TooLarge")
        return bytes(self.body) + cd + _EOCD.pack(b"PK\5\6", 0, 0, len(self.records), len(self.records), len(cd), at, 0)


def appended_directory(tail: bytes, base: int) -> bytes:
    """The directory block of bytes appended at ``base``, by the end record at their own end."""
    *_, size, offset, _ = _EOCD.unpack_from(tail, len(tail) - _EOCD.size)
    return tail[offset - base : offset - base + size]


def renamed(entry: Entry, name: bytes) -> Entry:
    return replace(entry, name_bytes=name)
