"""Byte formats, ZIP structures and codecs."""

import io
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.functions import codecs as C
from quireflow.functions import deflate as D
from quireflow.functions.hashing import crc32c_of, name_hash_of
from quireflow.sources import zip_format as Z

GEN = b"g" * 16


def sample_data(n, seed=0x12345678):
    out, state = bytearray(), seed
    for i in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(((state >> 24) & 0x1F) ^ (i & 7))
    return bytes(out)


def make_zip(entries, comment=b"", method=zipfile.ZIP_DEFLATED):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", method) as z:
        for name, data, *m in entries:
            z.writestr(zipfile.ZipInfo(name), data, compress_type=m[0] if m else method)
        z.comment = comment
    return b.getvalue()


def test_crc32c_check_value():
    assert crc32c_of(b"123456789") == 0xE3069283


@pytest.mark.parametrize("cls, size", [(C.IndexHeader, 128), (C.IndexEntry, 96), (C.JournalHeader, 88)])
def test_fixed_records(cls, size):
    raw = cls().encode()
    assert len(raw) == size and cls.decode(raw) == cls()
    with pytest.raises(C.BadFormat):
        cls.decode(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])


def test_record_sizes():
    assert len(C.encode_data(GEN, 1, "ab", 0, b"xyz")) == 46 + 2 + 3
    assert [len(C.encode_meta(GEN, 1, "ab", op, 5, "cd")) for op in ("CREATE", "REMOVE", "RESIZE", "RENAME")] == [38, 38, 46, 42]
    assert len(C.encode_marker(GEN, 1, 1)) == 40
    assert [len(C.Chunk(0, p, 0, [C.Checkpoint(0)]).encode()) for p in ("Deflate", "DeflateVmm", "Zstd")] == [36 + 32785, 36 + 24, 36 + 16]


def test_versions():
    raw = bytearray(C.JournalHeader().encode())
    raw[8:10] = struct.pack("<H", 2)
    raw[80:84] = struct.pack("<I", crc32c_of(bytes(raw[:80])))
    with pytest.raises(C.BadFormat, match="VersionUnsupported"):
        C.JournalHeader.decode(bytes(raw))
    intent = C.Intent("FULL", 1, b"a" * 16, 2, b"b" * 16)
    assert C.Intent.decode(intent.encode()) == intent and C.Intent.decode(intent.encode()[:-1]) is None and C.Intent.decode(None) is None
    assert [intent.state(*x) for x in ((1, b"a" * 16), (2, b"b" * 16), (1, None))] == ["pre", "post", "neither"]


def journal(*records, page_size=8):
    return C.JournalHeader(generation_id=GEN, page_size=page_size).encode() + b"".join(records)


def test_walk_stops():
    good = C.encode_data(GEN, 1, "a", 0, b"x")
    for bad in (good[:-1], good[:-1] + b"\0", C.encode_data(b"h" * 16, 2, "a", 0, b"x"), b"\0" * 40, C.encode_data(GEN, 2, "a", 0, bytes(9)), b"ab"):
        _, rows, stop = C.walk_journal(journal(good, bad))
        assert len(rows) == 1 and stop == 88 + len(good)
    assert C.walk_journal(journal(good))[2] is None
    with pytest.raises(C.BadFormat, match="HeaderTruncated"):
        C.walk_journal(b"VM")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.integers(0, 2**40), st.binary(max_size=8)), max_size=6))
def test_journal_round_trip(pages):
    raw = journal(*[C.encode_data(GEN, i, n, p, d) for i, (n, p, d) in enumerate(pages)])
    assert [(r["entry"], r["page_index"], r["data"]) for r in C.walk_journal(raw)[1]] == pages


def test_index_lookup_and_as_of():
    rows = [C.IndexRow(n, C.IndexEntry(provider="DeflateVmm"), [C.Checkpoint(0, 1), C.Checkpoint(10, 5), C.Checkpoint(20, 9)]) for n in ("a", "b", "ü")]
    index = C.Index(C.build_index(C.IndexHeader(), rows))
    i, e = index.lookup("ü")
    assert index.name(e) == "ü" and index.lookup("c") is None
    assert [index.nearest_checkpoint(e, t).compressed_offset for t in (0, 9, 10, 99)] == [1, 1, 5, 9]
    hashes = [index.entry(k).name_hash for k in range(3)]
    assert hashes == sorted(hashes) == sorted(map(name_hash_of, ("a", "b", "ü")))
    with pytest.raises(IndexError):
        index.entry(3)
    with pytest.raises(C.BadFormat):
        C.Index(index.data[:100])


def test_interleaved_chunks_and_cycle():
    rows = [C.IndexRow("a", C.IndexEntry(provider="Zstd"), [C.Checkpoint(0), C.Checkpoint(20, frame_offset=1)])]
    raw = bytearray(C.build_index(C.IndexHeader(), rows))
    at = C.Index(bytes(raw)).entry(0).chunk_head_offset
    second = len(raw)
    raw[at:] = C.Chunk(0, "Zstd", second, [C.Checkpoint(0), C.Checkpoint(20, frame_offset=1)]).encode()
    linked = bytes(raw) + C.Chunk(0, "Zstd", 0, [C.Checkpoint(10, frame_offset=2), C.Checkpoint(20, frame_offset=3)]).encode()
    index = C.Index(linked)
    assert [index.nearest_checkpoint(index.entry(0), t).frame_offset for t in (5, 15, 25)] == [0, 2, 3]
    cycle = C.Index(bytes(raw) + C.Chunk(0, "Zstd", at, []).encode())
    with pytest.raises(C.BadFormat, match="ChunkChainCycle"):
        cycle.nearest_checkpoint(cycle.entry(0), 1)


def test_advisory_clamps():
    a = C.Advisory([1, 2], [(0, 1, 2, 3, 4)])
    raw = a.encode()
    assert len(raw) == 8 * 2 + 8 + 24 and C.Advisory.decode(raw, 2) == a
    assert C.Advisory.decode(raw[:-1], 2) == C.Advisory([0, 0]) == C.Advisory.decode(b"", 2)


def test_zip_directory_against_zipfile():
    data = make_zip([("a.txt", b"hello"), ("dir/b.bin", sample_data(5000)), ("s", b"plain", zipfile.ZIP_STORED)], comment=b"a comment")
    d = Z.read_directory(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for e, info in zip(d.entries, z.infolist()):
            assert (e.name, e.crc32, e.compressed_size, e.local_header_offset) == (info.filename, info.CRC, info.compress_size, info.header_offset)
            assert D.read_range(e.method_code, Z.payload(data, e), 0, e.uncompressed_size, e.uncompressed_size) == z.read(info)


def test_end_record_in_a_comment_is_passed_over():
    data = make_zip([("a", b"1")], comment=b"PK\5\6 not the end")
    assert [e.name for e in Z.read_directory(data).entries] == ["a"]


def test_zip64_is_read_and_bad_archives_are_refused():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z, z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
        f.write(b"x" * 10)
    assert Z.read_directory(b.getvalue()).entries[0].uncompressed_size == 10
    for bad in (b"", b"PK", make_zip([("a", b"1")])[:-1]):
        with pytest.raises(Z.ZipError):
            Z.read_directory(bad)


def test_local_header_decides():
    data = make_zip([("a", b"1234", zipfile.ZIP_STORED)])
    e = Z.read_directory(data).entries[0]
    moved = data[:28] + struct.pack("<H", 4) + data[30:31] + b"\1\0\0\0" + data[31:]
    assert Z.data_offset(moved, e) == Z.data_offset(data, e) + 4


def test_ranges_and_resume_points():
    data = sample_data(300_000)
    packed, points = D.deflate_of(data, 8192)
    assert zlib.decompress(packed, -15) == data and len(points) == 36
    for at in (0, 5000, 33000, 100000, 200001, 299000):
        assert D.inflate_range(packed, at, 1000, len(data), points) == data[at : at + 1000] == D.inflate_range(packed, at, 1000, len(data))
    with pytest.raises(D.OutOfRange):
        D.inflate_range(packed, 299_500, 1000, len(data))
    with pytest.raises(D.CorruptData):
        D.inflate_range(packed[:100], 0, 1000, len(data))
    with pytest.raises(D.CorruptData):
        D.store_range(b"abc", 0, 5, 5)
    with pytest.raises(ValueError):
        D.store_range(b"abc", 0, 1, 3, [(0, 0)])
    with pytest.raises(D.UnsupportedMethod):
        D.read_range(93, b"", 0, 0, 0)
    two = [C.Checkpoint(10, 1), C.Checkpoint(10, 2)]
    assert D.nearest_point(two, 10) is two[1] and D.nearest_point(two, 9) is None and D.nearest_point([], 5) is None


def test_leads_are_empty_and_fill_a_byte_up_to_every_place():
    assert sorted(D._LEAD) == list(range(8))
    for bits, lead in D._LEAD.items():
        assert len(lead) % 8 == bits
        d = zlib.decompressobj(-15)
        assert d.decompress(D._packed(lead + "110" + "0000000")) == b"" and d.eof


@pytest.mark.parametrize("level", [1, 6, 9])
def test_checkpoints_of_foreign_streams(level):
    data = sample_data(300_000)
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = c.compress(data) + c.flush()
    points = D.build_checkpoints(packed, len(data), 8192)
    assert len(points) > 5 and any(p.bits for p in points) and all(len(p.window) == 32768 for p in points)
    assert all(b.uncompressed_offset - a.uncompressed_offset >= 8192 for a, b in zip(points, points[1:]))
    for at in (0, 5000, 33000, 100000, 200001, 299000):
        n = min(1000, len(data) - at)
        assert D.inflate_range(packed, at, n, len(data), points) == data[at : at + n]
        for p in points:  # whichever checkpoint before it is taken
            if p.uncompressed_offset <= at:
                assert D.inflate_range(packed, at, n, len(data), [p]) == data[at : at + n]
    # nothing before a checkpoint is read when decoding resumes there
    p = points[-1]
    blank = bytes(p.compressed_offset - 1) + packed[p.compressed_offset - 1 :]
    assert D.inflate_range(blank, p.uncompressed_offset, 100, len(data), points) == data[p.uncompressed_offset :][:100]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 40_000), st.integers(0, 99)), min_size=1, max_size=6), st.integers(1, 9), st.sampled_from([zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED]))
def test_checkpoints_of_any_stream(parts, level, strategy):
    import random

    data = b"".join([bytes([seed]) * n, random.Random(seed).randbytes(n), sample_data(n), b" ".join(str(i * seed).encode() for i in range(n // 8))][kind] for kind, n, seed in parts)
    c = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
    packed = c.compress(data) + c.flush()
    for p in D.build_checkpoints(packed, len(data), 4096):
        assert D.inflate_range(packed, p.uncompressed_offset, len(data) - p.uncompressed_offset, len(data), [p]) == data[p.uncompressed_offset :]


def test_streams_that_do_not_decode_give_no_checkpoints():
    data = sample_data(50_000)
    packed = zlib.compress(data)[2:-4]
    with pytest.raises(D.CorruptData):
        D.build_checkpoints(packed, len(data) - 1)
    with pytest.raises(D.CorruptData):
        D.build_checkpoints(b"\xff" + packed, len(data))
    assert D.build_checkpoints(packed, 0) == [] and D.build_checkpoints(b"", 5) == []


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 2000, 5000])
def test_crc32c_of_any_length(n):
    from quireflow.functions.hashing import crc32c_of

    data = bytes((i * 37 + i // 7) % 256 for i in range(n))
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    assert crc32c_of(data) == c ^ 0xFFFFFFFF
    assert crc32c_of(b"123456789") == 0xE3069283
