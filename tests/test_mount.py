"""Sessions and mounts: editing, committing, crashing and recovering."""

import io
import os
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.functions import codecs as C
from quireflow.operators.session import EntryError, Session
from quireflow.plans.mount import Conflict, Mount
from quireflow.sources import zip_format as Z
from test_formats import make_zip


def session(content=None, **options):
    content = {"a.bin": b"0123456789abcdef"} if content is None else content
    return Session({n: (len(c), True) for n, c in content.items()}, source=lambda n, at, k: content[n][at : at + k], **options)


def test_write_read_and_zero_fill():
    s = session(page_size=4)
    s.write("a.bin", 6, b"XY")
    assert s.content("a.bin") == b"012345XY89abcdef"
    s.write("a.bin", 20, b"Z")
    assert s.content("a.bin") == b"012345XY89abcdef" + bytes(4) + b"Z" and s.size("a.bin") == 21
    assert s.read("a.bin", 19, 100) == b"\0Z"


def test_clean_reads_are_strict():
    with pytest.raises(EntryError, match="OutOfRange"):
        session().read("a.bin", 10, 10)


def test_shrink_then_extend_reads_zeros():
    for limit in (None, 0):
        s = session(page_size=8, limit=limit)
        s.write("a.bin", 0, b"################")
        s.truncate("a.bin", 3)
        s.truncate("a.bin", 12)
        assert s.content("a.bin") == b"###" + bytes(9)
    s = session(page_size=8)
    s.truncate("a.bin", 3)
    s.truncate("a.bin", 12)
    assert s.content("a.bin") == b"012" + bytes(9)


def test_names():
    s = session()
    with pytest.raises(EntryError, match="Exists"):
        s.create("a.bin")
    with pytest.raises(EntryError, match="NotFound"):
        s.remove("x")
    s.rename("a.bin", "b")
    s.rename("b", "c")
    assert s.overlay["c"] == ("Aliased", "a.bin") and s.kind("b") == "Absent" and s.content("c") == b"0123456789abcdef"
    s.create("a.bin")
    s.write("a.bin", 0, b"new")
    assert s.content("a.bin") == b"new" and s.content("c").startswith(b"0123")
    with pytest.raises(EntryError, match="Exists"):
        s.rename("c", "c")
    unknown = Session({"z": (5, False)})
    with pytest.raises(EntryError, match="Unsupported"):
        unknown.truncate("z", 1)
    unknown.rename("z", "y")
    unknown.remove("y")


def test_spill_is_first_in_first_out():
    s = session({}, page_size=8, limit=16)
    s.create("n")
    for p in range(4):
        s.write("n", p * 8, bytes([65 + p]) * 8)
    assert sorted(s.dirty["n"].spilled) == [0, 1] and sorted(s.dirty["n"].pages) == [2, 3]
    s.write("n", 0, b"zz")
    assert 0 in s.dirty["n"].spilled and s.content("n") == b"zzAAAAAA" + b"B" * 8 + b"C" * 8 + b"D" * 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.just("w"), st.integers(0, 40), st.binary(min_size=1, max_size=20)), st.tuples(st.just("t"), st.integers(0, 50))), max_size=12), st.sampled_from([None, 0, 16]))
def test_session_equals_a_byte_array(ops, limit):
    s, plain = session(page_size=8, limit=limit), bytearray(b"0123456789abcdef")
    for op in ops:
        if op[0] == "w":
            _, at, data = op
            s.write("a.bin", at, data)
            plain.extend(bytes(max(0, at + len(data) - len(plain))))
            plain[at : at + len(data)] = data
        else:
            s.truncate("a.bin", op[1])
            plain = bytearray(plain[: op[1]].ljust(op[1], b"\0"))
    assert s.content("a.bin") == bytes(plain)


@pytest.fixture
def archive(tmp_path):
    path = str(tmp_path / "x.zip")
    with open(path, "wb") as f:
        f.write(make_zip([("a.bin", b"ORIGINAL"), ("keep.bin", bytes(range(256)) * 4), ("gone", b"bye")]))
    return path


def contents(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        return {n: z.read(n) for n in z.namelist()}


def edit(m):
    m.write("a.bin", 0, b"ZZ")
    m.create("new")
    m.write("new", 3, b"n")
    m.remove("gone")
    m.rename("keep.bin", "kept")


EDITED = {"a.bin": b"ZZIGINAL", "new": b"\0\0\0n", "kept": bytes(range(256)) * 4}


@pytest.mark.parametrize("how", ["commit_full", "commit_incremental"])
def test_commit(archive, how):
    before = open(archive, "rb").read()
    m = Mount(archive, page_size=4)
    edit(m)
    getattr(m, how)()
    assert contents(archive) == EDITED
    if how == "commit_incremental":
        assert open(archive, "rb").read().startswith(before)
    with pytest.raises(Conflict):
        m.read("a.bin", 0, 1)
    again = Mount(archive)
    assert sorted(again.names()) == sorted(EDITED) and not again.is_dirty()


def test_unmodified_entries_keep_their_records(archive):
    b = io.BytesIO()
    info = zipfile.ZipInfo("rich", (2001, 2, 3, 4, 5, 6))
    info.external_attr, info.comment, info.extra = 0o644 << 16, b"note", b"\x99\x99\x02\0ab"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(info, b"0123")
        z.writestr("other", b"x")
    open(archive, "wb").write(b.getvalue())
    for how in ("commit_full", "commit_incremental"):
        m = Mount(archive)
        m.write("other", 0, b"y")
        getattr(m, how)()
        with zipfile.ZipFile(archive) as z:
            got = z.getinfo("rich")
            assert (got.date_time, got.external_attr, got.comment, got.extra, z.read("rich"), z.read("other")) == (info.date_time, info.external_attr, b"note", info.extra, b"0123", b"y")


def test_policy_and_compaction(archive):
    assert Mount(archive).commit() == "Noop"
    m = Mount(archive)
    m.write("keep.bin", 0, os.urandom(1024))
    assert m.commit() == "Incremental"
    while not (m := Mount(archive)).should_full_commit():
        m.write("keep.bin", 0, os.urandom(1024))
        m.commit_incremental()
    m.write("a.bin", 0, b"Q")
    assert m.commit() == "Full" and Mount(archive).bloat()["bloat_ratio"] < 1.2
    m = Mount(archive)
    m.write("a.bin", 0, b"R")
    with pytest.raises(Conflict):
        m.compact()


def test_stale_is_sticky(archive):
    m = Mount(archive)
    assert m.read("a.bin", 0, 3) == b"ORI"
    os.utime(archive, ns=(1, 1))
    assert m.read("a.bin", 0, 3) == b"ORI"  # cached: only a miss looks at the file
    with pytest.raises(Conflict, match="stale"):
        m.read("keep.bin", 0, 3)
    assert m.stale
    with pytest.raises(Conflict, match="stale"):
        m.read("a.bin", 0, 3)
    with pytest.raises(Conflict):
        m.write("a.bin", 0, b"x")


class Crash(Exception):
    pass


@pytest.mark.parametrize("how", ["commit_full", "commit_incremental"])
@pytest.mark.parametrize("at", ["intent", "half", "replaced", "appended", "cleanup"])
def test_a_commit_cut_off_is_finished_or_undone(archive, how, at):
    m = Mount(archive, dirty_limit=1 << 20)
    m.write("a.bin", 0, b"ZZ")

    def stop(label):
        if label == at:
            raise Crash

    m.point = stop
    try:
        getattr(m, how)()
    except Crash:
        pass
    again = Mount(archive)
    assert again.read("a.bin", 0, 8) == (b"ZZIGINAL")  # either committed or recovered from the flushed journal
    assert not os.path.exists(again.intent_path)


def test_recovery_decisions(archive):
    m = Mount(archive, page_size=64, dirty_limit=0)
    m.write("keep.bin", 0, b"\x11" * 64)
    with pytest.raises(Conflict):
        Mount(archive, page_size=64)  # nothing committed
    assert Mount(archive, page_size=64, handler=lambda r: "RecoverAll").read("keep.bin", 0, 64) == b"\x11" * 64
    m = Mount(archive, page_size=64, dirty_limit=0)
    m.rename("a.bin", "b.bin")
    m.create("a.bin")
    m.flush()
    back = Mount(archive, page_size=64)
    assert back.read("keep.bin", 0, 64) == b"\x11" * 64 and back.read("b.bin", 0, 8) == b"ORIGINAL" and back.read("a.bin", 0, 8) == b""
    with pytest.raises(Conflict, match="pages"):
        Mount(archive, page_size=32)
    with open(archive, "ab") as f:
        f.write(b"")
    data = open(archive, "rb").read()
    open(archive, "wb").write(make_zip([("other", b"1")]))
    with pytest.raises(Conflict, match="another source"):
        Mount(archive, page_size=64)
    open(archive, "wb").write(data)
    open(m.journal_path, "wb").write(b"junk")
    with pytest.raises(Conflict, match="HeaderTruncated"):
        Mount(archive)
    Mount(archive, handler=lambda r: "Discard")
    assert not os.path.exists(m.journal_path)


def test_journal_compaction(archive):
    m = Mount(archive, page_size=8, dirty_limit=0)
    for i in range(10):
        m.write("a.bin", 0, bytes([65 + i]))
    assert m.should_compact_journal()
    m.compact_journal()
    assert not m.should_compact_journal()
    with open(m.journal_path, "rb") as f:
        assert [r["kind"] for r in C.walk_journal(f.read())[1]] == ["DATA", "COMMIT"]
    assert Mount(archive, page_size=8).read("a.bin", 0, 2) == b"JR"


def test_index_is_reused_only_for_the_same_directory(archive):
    assert Mount(archive).rebuilt and not Mount(archive).rebuilt
    open(archive, "wb").write(make_zip([("q", b"1")]))
    assert Mount(archive).rebuilt
    open(Mount(archive).index_path, "wb").write(b"broken")
    assert Mount(archive).rebuilt


def test_written_limits():
    w = Z.Writer(0xFFFFFFFF)
    w.add(Z.NewEntry(b"a", 0, b""))
    with pytest.raises(Z.ZipError, match="TooLarge"):
        w.finish()
    with pytest.raises(Z.ZipError, match="TooLarge"):
        Z.Writer(1 << 32).add(Z.NewEntry(b"a", 0, b""))


def test_memory_mount():
    from quireflow.plans.memory import MemoryMount

    big = os.urandom(20_000)
    data = make_zip([("a", b"hello"), ("big", big)])
    m = MemoryMount(data, page_size=1024, read_ahead=8)
    assert m.rebuilt and not MemoryMount(data, m.index_bytes).rebuilt and MemoryMount(data, b"junk").rebuilt
    asked = []
    assert m.read("big", 0, 1, lambda: asked.append(1)) == big[:1]
    assert (m.cache.misses, len(m.cache), asked) == (1, 9, [1])
    assert m.read("big", 500, 12_000) == big[500:12_500] and m.read("big", 8000, 100) == big[8000:8100]
    with pytest.raises(EntryError, match="OutOfRange"):
        m.read("big", 19_999, 2)
    m.write("a", 5, b"!")
    m.rename("big", "b")
    m.create("c")
    for image in (m.commit_full(), m.commit_incremental()):
        with zipfile.ZipFile(io.BytesIO(image)) as z:
            assert {n: z.read(n) for n in z.namelist()} == {"a": b"hello!", "b": big, "c": b""}
    assert m.read_entry("big", 10, 5) == big[10:15]
    with pytest.raises(EntryError, match="NotFound"):
        m.read_entry("c", 0, 0)


def test_index_header_can_be_refreshed():
    h = C.IndexHeader(source_file_size=1).refreshed(5, 6, 7)
    assert (h.source_file_size, h.source_inode, h.source_mtime_ns) == (5, 6, 7) and C.IndexHeader.decode(h.encode()) == h


# reads, tiers and the journal as a summary


def sample(n, seed=0x9E3779B9):
    out = bytearray(n)
    for i in range(n):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = (seed >> 24 & 0x1F) ^ (i & 7)
    return bytes(out)


@pytest.fixture
def mixed(tmp_path):
    path, big = str(tmp_path / "mixed.zip"), sample(180_000)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("notes.txt", b"hello, stored world", zipfile.ZIP_STORED)
        z.writestr("big.bin", big, zipfile.ZIP_DEFLATED)
    return path, big


def test_one_byte_makes_nine_pages_resident(mixed):
    path, big = mixed
    m = Mount(path, interval=16 << 10)
    assert m.index.entry(m.index.lookup("big.bin")[0]).checkpoint_count > 3
    assert m.read("big.bin", 100_000, 1) == big[100_000:100_001]
    assert (len(m.cache), m.cache.misses) == (9, 1)
    assert m.read("big.bin", 100_000, 20_000) == big[100_000:120_000] and m.cache.misses == 1
    assert m.read("notes.txt", 7, 6) == b"stored"
    with pytest.raises(EntryError, match="OutOfRange"):
        m.read("big.bin", 179_999, 2)
    again = Mount(path)  # checkpoints come from the index file
    assert not again.rebuilt and all(again.read("big.bin", at, 777) == big[at : at + 777] for at in (0, 5000, 33000, 100000, 170001))


def test_reads_decode_from_the_nearest_checkpoint(mixed, monkeypatch):
    from quireflow.plans import reader

    path, big = mixed
    m, seen = Mount(path, interval=16 << 10, read_ahead=0, cache_bytes=4096), []
    plain = reader.read_range
    monkeypatch.setattr(reader, "read_range", lambda method, data, offset, length, size, points: seen.append((offset, [p.uncompressed_offset for p in points])) or plain(method, data, offset, length, size, points))
    for at in range(0, 180_000, 12_345):
        assert m.read("big.bin", at, 10) == big[at : at + 10]
    assert sum(offset - (points[0] if points else 0) for offset, points in seen) < len(seen) * (64 << 10) and sum(bool(p) for _, p in seen) > 10


def test_a_miss_looks_at_the_file_and_may_be_refused(mixed):
    path, big = mixed
    m = Mount(path, read_ahead=0, estale_interval=2)
    m.read("big.bin", 0, 10)
    os.utime(path, ns=(1, 1))
    assert m.read("big.bin", 5, 10) == big[5:15]  # in the cache: nothing is looked at
    with pytest.raises(Conflict, match="stale"):
        m.read("big.bin", 50_000, 10)
    with pytest.raises(Conflict, match="stale"):  # and so for good
        m.read("big.bin", 0, 10)

    def refuse():
        raise PermissionError

    with pytest.raises(PermissionError):
        Mount(path).read("big.bin", 0, 1, on_miss=refuse)


def test_spilled_pages_leave_memory(mixed):
    path, big = mixed
    m = Mount(path, page_size=512, dirty_limit=4 * 512)
    want = bytearray(big)
    for i in range(200):
        at = i * 797 % 170_000
        m.write("big.bin", at, b"%06d" % i)
        want[at : at + 6] = b"%06d" % i
        held = sum(len(v[1]) for d in m.session.dirty.values() for v in d.pages.values())
        assert held <= 4 * 512 and m.session.held * 512 == held
    assert len(m.session.indexed_pages()) > 150 and all(isinstance(place, tuple) for place, _ in m.session.dirty["big.bin"].spilled.values())
    assert m.read("big.bin", 0, len(big)) == want
    m.rename("big.bin", "moved.bin")
    m.truncate("moved.bin", 100_100)
    m.truncate("moved.bin", 100_200)
    want = want[:100_100] + bytes(100)
    assert m.read("moved.bin", 0, 200_000) == want
    size = os.path.getsize(m.journal_path)
    for i in range(3):
        for at in range(0, 100_000, 512):
            m.write("moved.bin", at, b"again%d" % i)
            want[at : at + 6] = b"again%d" % i
    assert m.should_compact_journal()
    m.compact_journal()
    assert not m.should_compact_journal() and os.path.getsize(m.journal_path) < size * 3
    assert m.read("moved.bin", 0, 200_000) == want
    m.flush()
    m.close()
    again = Mount(path, page_size=512)
    assert again.read("moved.bin", 0, 200_000) == want and again.commit() in ("Full", "Incremental")
    assert zipfile.ZipFile(path).read("moved.bin") == want


def test_a_short_journal_is_an_error_not_zeros(mixed):
    m = Mount(mixed[0], page_size=512, dirty_limit=0)
    m.write("big.bin", 0, b"x" * 512)
    os.truncate(m.journal_path, 100)
    with pytest.raises(OSError):
        m.read("big.bin", 0, 1)


def test_reset():
    s = session()
    s.write("a.bin", 0, b"zz")
    s.rename("a.bin", "b")
    s.reset()
    assert not s.is_dirty() and s.names() == ["a.bin"] and s.content("a.bin") == b"0123456789abcdef"


STEP = st.one_of(
    st.tuples(st.just("WRITE"), st.sampled_from("abcd"), st.integers(0, 40), st.binary(max_size=12)),
    st.tuples(st.sampled_from(["CREATE", "REMOVE"]), st.sampled_from("abcd")),
    st.tuples(st.just("RESIZE"), st.sampled_from("abcd"), st.integers(0, 40)),
    st.tuples(st.just("RENAME"), st.sampled_from("abcd"), st.sampled_from("abcd")),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(STEP, max_size=25), st.sampled_from([None, 0, 16]))
def test_a_summary_leads_to_the_same_state(steps, limit):
    content = {"a": bytes(range(30)), "b": b"bbbbb", "c": b""}
    s, twin = session(content, page_size=8, limit=limit), session(content, page_size=8)
    for kind, name, *rest in steps:
        try:
            if kind == "WRITE":
                s.write(name, *rest)
            else:
                s.apply(kind, name, new_size=rest[0] if kind == "RESIZE" else 0, new_name=rest[0] if kind == "RENAME" else "")
        except EntryError:
            pass
    for r in s.summary():
        if r["kind"] == "META":
            twin.apply(r["op"], r["entry"], new_size=r["new_size"] or 0, new_name=r["new_name"] or "")
        else:
            twin.write(r["entry"], r["page_index"] * 8, r["data"])
    assert sorted(twin.names()) == sorted(s.names())
    for n in s.names():
        assert (twin.kind(n), twin.source_of(n), twin.content(n)) == (s.kind(n), s.source_of(n), s.content(n))
        assert (n in twin.dirty) == (n in s.dirty)
        if n in s.dirty:
            assert (twin.dirty[n].logical, twin.dirty[n].source_size) == (s.dirty[n].logical, s.dirty[n].source_size)
