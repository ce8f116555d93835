"""DataFrame operators, sources, streaming and the registered queries."""

import json
import os
import zlib
from collections import OrderedDict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_formats import make_zip, sample_data

from quireflow.functions import codes, geometry, hashing
from quireflow.functions import codecs as C
from quireflow.operators import cache, journal, lookup, overlay, pages, policy, session
from quireflow.plans import mount, registry
from quireflow.sources import archives
from quireflow.streaming import journal_tail

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, cols):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canonical(df.collect(), cols)
    if name in registry.ORACLES:
        x = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in x.description]
        assert sorted(names) == cols
        assert got == canonical([dict(zip(names, r)) for r in x.fetchall()], cols)
    else:
        assert got


def test_geometry(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 4096, 4097, 8192)], "n long").select("n", geometry.page_count("n").alias("c"), geometry.pages("n").alias("p"), geometry.page_length("n", F.lit(1)).alias("l")).collect()
    assert [(r.c, r.p, r.l) for r in got] == [(0, [], 0), (1, [0], 0), (1, [0], 0), (2, [0, 1], 1), (2, [0, 1], 4096)]
    assert spark.range(1).select(geometry.read_ahead(F.lit(3), F.lit(6)).alias("r")).first().r == [3, 4, 5]


def test_codes(spark):
    df = spark.createDataFrame([(0,), (8,), (93,), (12,)], "m int").select(codes.provider_of_method("m").alias("p")).select("p", codes.provider_code("p").alias("c"), codes.record_size("p").alias("r"))
    assert [tuple(r) for r in df.collect()] == [("Store", 0, None), ("Deflate", 1, 32785), ("Zstd", 3, 16), ("Unsupported", 255, None)]
    ops = spark.createDataFrame([("CREATE",), ("RENAME",), ("x",)], "o string").select(codes.op_code("o").alias("c"))
    assert [r.c for r in ops.collect()] == [1, 4, None]


def test_hashes(spark):
    r = spark.createDataFrame([(b"123456789", "name")], "d binary, n string").select(hashing.crc32c("d").alias("c"), F.crc32("d").alias("z"), hashing.name_hash("n").alias("h"), hashing.cd_hash("d").alias("k")).first()
    assert (r.c, r.z) == (0xE3069283, zlib.crc32(b"123456789")) and len(r.h) == 16 and len(r.k) == 16


def test_as_of_ties_and_nulls(spark):
    points = spark.createDataFrame([("a", 0, 1, "x"), ("a", 10, 1, "y"), ("a", 10, 2, "z"), (None, 0, 1, "n")], "k string, at int, chunk int, v string")
    probes = spark.createDataFrame([("a", -1), ("a", 5), ("a", 10), ("b", 5), (None, 5)], "k string, at int")
    for stride in (None, 3, 100):
        got = {(r.k, r.at): r.nearest for r in lookup.as_of(probes, points, ["k"], "at", "v", tie="chunk", stride=stride).collect()}
        assert got == {("a", -1): None, ("a", 5): "x", ("a", 10): "z", ("b", 5): None, (None, 5): None}


def test_overlay_resolution(spark):
    index = spark.createDataFrame([("a", 5, "Deflate"), ("b", 6, "Unsupported"), ("c", 7, "Store")], "name string, uncompressed_size long, provider string")
    over = spark.createDataFrame([("a", "Tombstone", None), ("x", "Aliased", "a"), ("n", "Created", None)], "name string, kind string, source string")
    names = spark.createDataFrame([(n,) for n in "abcxnz"], "name string")
    got = {r.name: (r.kind, r.status, r.original_size) for r in overlay.resolve(names, over, index).collect()}
    assert got == {"a": ("Absent", "NotFound", None), "b": ("Source", "Unsupported", 6), "c": ("Source", "Ok", 7), "x": ("Source", "Ok", 5), "n": ("Created", "Ok", 0), "z": ("Absent", "NotFound", None)}
    assert sorted((r.name, r.origin) for r in overlay.effective(index, over).collect()) == [("b", "Kept"), ("c", "Kept"), ("n", "Created"), ("x", "Aliased")]


def test_pages_and_tiers(spark):
    e = spark.createDataFrame([("a", b"0123456789"), ("empty", b""), ("none", None)], "name string, d binary")
    cut = pages.split(e, "name", "d", 4)
    assert sorted((r.name, r.page_index, bytes(r.data)) for r in cut.collect()) == [("a", 0, b"0123"), ("a", 1, b"4567"), ("a", 2, b"89")]
    assert bytes(pages.assemble(cut, "name").first().content) == b"0123456789"
    reads = spark.createDataFrame([("a", 2, 3), ("a", 8, 5), ("zz", 0, 1)], "name string, offset long, length long")
    for strict, want in ((True, "OutOfRange"), (False, "Ok")):
        got = {(r.name, r.offset): (r.status, r.bytes and bytes(r.bytes)) for r in pages.read(e, reads, "name", "d", strict=strict).collect()}
        assert got[("a", 2)] == ("Ok", b"234") and got[("a", 8)][0] == want and got[("zz", 0)][0] == "NotFound"
    r = spark.range(1).select(pages.patch(pages.full_page(F.lit(b"ab"), 6), F.lit(1), F.lit(b"XY")).alias("p"), pages.source_page(F.lit(b"abcdef"), F.lit(0).cast("long"), F.lit(2).cast("long"), 4).alias("s")).first()
    assert bytes(r.p) == b"aXY\0\0\0" and bytes(r.s) == b"ab\0\0"


def test_journal_frames(spark):
    rows = [("l", 0, "DATA", 1, "a", 0, b"x", None), ("l", 1, "DATA", 2, "a", 0, b"y", None), ("l", 2, "COMMIT", None, None, None, None, 2), ("l", 3, "DATA", 3, "a", 1, b"z", None)]
    j = spark.createDataFrame(rows, "log string, file_offset long, kind string, sequence long, entry string, page_index long, data binary, commit_sequence long")
    assert {r.sequence: r.committed for r in journal.classify(j, ["log"]).collect()} == {1: True, 2: True, 3: False}
    assert {r.page_index: bytes(r.data) for r in journal.live_pages(j, ["log"]).collect()} == {0: b"y", 1: b"z"}
    s = journal.summary(j, ["log"]).first()
    assert (s.committed, s.uncommitted, s.last_commit_seq, s.valid_through_seq) == (2, 1, 2, 3)
    assert journal.space(j, ["log"]).first().should_compact is False


def test_spill_against_a_session(spark):
    import random

    random.seed(4)
    writes = [random.randrange(40) for _ in range(200)]
    j = spark.createDataFrame([("l", "DATA", i, "e", p) for i, p in enumerate(writes)], "log string, kind string, sequence long, entry string, page_index long")
    for resident in (0, 1, 7, 100):
        s = session.Session({}, page_size=8, limit=8 * resident)
        s.create("e")
        for p in writes:
            s.write("e", p * 8, b"12345678")
        got = {r.page_index for r in journal.spill(j, ["log"], resident, salts=3).collect() if r.spilled}
        assert got == set(s.dirty["e"].spilled)


def test_policies(spark):
    c = F.lit
    r = spark.range(1).select(
        policy.recovery_decision(c("Ok"), c(False), c(False), c(3)).alias("a"),
        policy.recovery_decision(c("Ok"), c(False), c(False), c(0)).alias("b"),
        policy.recovery_decision(c("HeaderCrcBad"), c(False), c(True), c(0)).alias("d"),
        policy.fingerprint_verdict(c("h"), c("h"), c(False), c(True)).alias("e"),
        policy.fresh(c(1), c(1), c(2), c(2), c(None), c(3)).alias("f"),
        policy.bloat_ratio(c(5), c(0)).alias("g"),
        policy.should_full(c(1.0), c(10), most_bytes=10).alias("h"),
    ).first()
    assert tuple(r) == ("RecoverCommitted", "Abort", "Abort", "ValidStale", False, 1.0, True)


def test_page_cache():
    c = cache.PageCache(2)
    for k in "aba":
        if c.get(k) is None:
            c.insert(k, b"1")
    c.insert("c", b"1")
    assert "a" in c and "b" not in c and (c.hits, c.misses, len(c)) == (1, 2, 2)
    c.insert("big", b"12345")
    assert len(c) == 1 and "big" in c
    assert cache.fill_run(cache.PageCache(9), "e", 5, 100, 8) == list(range(5, 14))


def test_cache_simulation_against_a_plain_one(spark):
    import random

    random.seed(1)
    acc = [("s", i, "e", random.randrange(12)) for i in range(200)]
    held, hits = OrderedDict(), 0
    for _, _, _, p in acc:
        if p in held:
            hits += 1
            held.move_to_end(p)
        else:
            held[p] = 1
            if len(held) > 4:
                held.popitem(last=False)
    df = spark.createDataFrame(acc, "log string, i int, e string, p long")
    got = cache.simulate(df, "log", "i", "e", "p", 12, 10, 40).first()
    assert (got.hits, got.misses, got.resident) == (hits, 200 - hits, 4)


def test_replay_matches_a_session(spark):
    ops = spark.createDataFrame(
        [("z", 1, "WRITE", "a", 2, b"XY", None, None), ("z", 2, "RENAME", "a", None, None, None, "b"), ("z", 3, "CREATE", "a", None, None, None, None), ("z", 4, "REMOVE", "nope", None, None, None, None), ("z", 5, "RESIZE", "b", None, None, 3, None)],
        "archive_id string, sequence long, op string, entry string, offset long, data binary, new_size long, new_name string",
    )
    base = spark.createDataFrame([("z", "a", b"0123456789")], "archive_id string, name string, content binary")
    rows = session.replay(ops, base, page_size=4).collect()
    assert {(r.name, r.kind, r.source) for r in rows if r.what == "overlay"} == {("a", "Created", None), ("b", "Aliased", "a")}
    assert [(r.name, r.kind) for r in rows if r.what == "refused"] == [("nope", "NotFound")]
    assert {r.name: (r.logical_size, r.source_size) for r in rows if r.what == "entry"} == {"a": (0, 0), "b": (3, 3)}
    assert [(r.name, bytes(r.data)) for r in rows if r.what == "page"] == [("b", b"01X\0")]


def test_sources(spark, tmp_path):
    big = sample_data(20_000)
    (tmp_path / "one.zip").write_bytes(make_zip([("a.txt", b"hello"), ("b", big)]))
    (tmp_path / "two.zip").write_bytes(b"not a zip")
    got = archives.with_content(archives.read_entries(spark, str(tmp_path / "*.zip"))).collect()
    assert {r.name: bytes(r.content) for r in got if r.name} == {"a.txt": b"hello", "b": big}
    assert [r.error for r in got if r.name is None] == ["EocdNotFound"]
    a = {os.path.basename(r.archive_id): r for r in archives.read_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert a["one.zip"].entry_count == 2 and a["one.zip"].bloat_ratio > 1 and a["two.zip"].error
    archives.register(spark)
    z = spark.read.format("zipentries").load(str(tmp_path)).where("name = 'b'")
    assert [(r.name, r.crc32) for r in z.select("name", "crc32").collect()] == [("b", zlib.crc32(big))]


def test_sidecar_sources(spark, tmp_path):
    path = str(tmp_path / "x.zip")
    open(path, "wb").write(make_zip([("a", b"hello")]))
    m = mount.Mount(path, dirty_limit=0)
    m.write("a", 0, b"J")
    m.flush()
    assert [(r.name, r.provider) for r in archives.read_index(spark, m.index_path).collect()] == [("a", "Deflate")]
    j = archives.read_journal(spark, m.journal_path)
    assert [r.kind for r in j.orderBy("file_offset").collect()] == ["DATA", "COMMIT"] and journal.summary(j, ["archive_id"]).first().committed == 1
    p = tmp_path / "idx"
    p.write_bytes(C.build_index(C.IndexHeader(), [C.IndexRow("a", C.IndexEntry(provider="Zstd"), [C.Checkpoint(7, frame_offset=3)])]))
    assert [(r.name, r.uncompressed_offset, r.frame_offset) for r in archives.read_checkpoints(spark, str(p)).collect()] == [("a", 7, 3)]
    (tmp_path / "i1").write_bytes(C.Intent("FULL", 1, b"a" * 16, 2, b"b" * 16).encode())
    (tmp_path / "i2").write_bytes(b"torn")
    assert [r.mode for r in archives.read_intents(spark, str(tmp_path / "i[12]")).collect()] == ["FULL"]


def test_journal_stream(spark, tmp_path):
    schema = "log string, file_offset long, kind string, sequence long, entry string, page_index long, data binary, commit_sequence long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("l", 0, "DATA", 1, "a", 0, b"x", None), ("l", 1, "DATA", 2, "a", 0, b"y", None)],
        [("l", 2, "COMMIT", None, None, None, None, 2), ("l", 3, "DATA", 3, "a", 1, b"z", None)],
        [("l", 4, "COMMIT", None, None, None, None, 3), ("m", 0, "DATA", 1, "a", 0, b"never", None)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{src}/{i}")
        q = journal_tail.committed_pages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.entry, r.page_index, bytes(r.data), r.commit_sequence) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, b"y", 2), ("a", 1, b"z", 3)]


def test_write_archives(spark, tmp_path):
    import zipfile

    rows = [("one.zip", "a", 0, b"stored", 1), ("one.zip", "b", 8, b"x" * 1000, 0), ("two.zip", "c", 8, None, 0)]
    df = spark.createDataFrame(rows, "archive_id string, name string, method_code int, content binary, cd_ordinal int")
    archives.write_archives(df, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["one.zip", "two.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "one.zip") as z:
        assert z.testzip() is None and z.namelist() == ["b", "a"] and z.read("a") == b"stored" and z.getinfo("b").compress_size < 100
    back = archives.with_content(archives.read_entries(spark, str(tmp_path / "out" / "*.zip")))
    assert {r.name: bytes(r.content) for r in back.collect()} == {"a": b"stored", "b": b"x" * 1000, "c": b""}


def test_layouts_match_what_is_written(spark):
    from quireflow.operators import layout
    from quireflow.sources import zip_format as Z

    content = {"b": b"1" * 100, "a": b"22", "ü": b"333"}
    data = archives.archive_image([(n, 0, c) for n, c in content.items()])
    rows = [("z", n, "Kept", len(c), False, i) for i, (n, c) in enumerate(content.items())]
    df = spark.createDataFrame(rows, "archive string, name string, origin string, compressed_size long, modified boolean, i int")
    full = layout.commit_layout(df, ["archive"], "i")
    assert {r.name: r.local_header_offset for r in full.collect()} == {e.name: e.local_header_offset for e in Z.read_directory(data).entries}
    size = layout.commit_size(full, ["archive"]).first()
    assert size.body_bytes + size.directory_bytes == len(data)
    index = C.Index(mount.build_index(data, Z.read_directory(data), mount.Stat(len(data), 0, 0)))
    got = layout.index_layout(df.select("archive", "name"), ["archive"], hashing.name_hash("name"))
    assert {r.entry_idx: (r.name, r.name_offset) for r in got.collect()} == {i: (index.name(e), e.name_offset) for i in range(3) if (e := index.entry(i))}
    assert layout.index_size(got, ["archive"]).first().advisory_offset == index.header.advisory_offset


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_without_sql(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.crc32 for r in registry.QUERIES["entry_crc32"](spark, SF).collect()} == {i: zlib.crc32(t) for i, t in docs.items()}
    web = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.QUERIES["entry_hashes"](spark, SF).collect():
        raw = web[r.page_id].html.encode()
        assert (r.name_hash, r.cd_hash.lower()) == (f"{hashing.name_hash_of(web[r.page_id].url):016x}", hashing.cd_hash_of(raw).hex())
    ev = [r for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect() if r.event_type == "view"]
    got = {r.log: (r.hits, r.misses) for r in registry.QUERIES["lru_cache_sim"](spark, SF).collect()}
    caches = {}
    for r in ev:
        c = caches.setdefault(r.user_id, cache.PageCache(8 * 4096))
        k = int(json.loads(r.props)["k"])
        if c.get(k) is None:
            c.insert(k, b"", 4096)
    assert got == {u: (c.hits, c.misses) for u, c in caches.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_session_replay_against_one_session_at_a_time(spark):
    import hashlib

    from quireflow.plans import queries

    ops, base = queries.session_log(spark, SF)
    content = {r.archive_id: r.content for r in base.collect()}
    logs = {}
    for r in ops.collect():
        logs.setdefault(r.archive_id, []).append(r)
    assert {r.op for log in logs.values() for r in log} == {"WRITE", "CREATE", "REMOVE", "RESIZE", "RENAME"}
    want = set()
    for a, log in logs.items():
        data = content.get(a)
        s = session.Session({"e": (len(data or b""), data is not None)} if a in content else {}, 64, 16 * 64, lambda n, at, k, data=data: data[at : at + k])
        for r in sorted(log, key=lambda r: r.sequence):
            try:
                s.apply(r.op, r.entry, r.offset, bytes(r.data), r.new_size, r.new_name)
            except session.EntryError as e:
                want.add((a, "refused", r.entry, e.status, r.sequence))
        want |= {(a, "overlay", n, k, src) for n, (k, src) in s.overlay.items()}
        for n, d in s.dirty.items():
            want.add((a, "entry", n, d.logical, d.source_size))
            want |= {(a, "page", n, p, 1, hashlib.md5(bytes(v[1])).hexdigest()) for p, v in d.pages.items()}
            want |= {(a, "page", n, p, 2, hashlib.md5(place[:counts]).hexdigest()) for p, (place, counts) in d.spilled.items()}
    shape = {"refused": ("kind", "sequence"), "overlay": ("kind", "source"), "entry": ("logical_size", "source_size"), "page": ("page_index", "tier", "digest")}
    got = [(r.archive_id, r.what, r.name, *(r[c] for c in shape[r.what])) for r in registry.QUERIES["session_replay"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["zip_round_trip", "archive_directories", "index_records", "checkpoint_reads", "journal_walk", "entry_crc32c", "rename_chain_fold", "truncate_sizes", "create_remove", "overlay_resolve", "read_ahead_sim", "lru_cache_sim"])
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "documents", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    x = c.execute(registry.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(x.description)}
    assert sorted(at) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[at[c]] for c in cols) for r in x.fetchall()), key=repr)


def test_replay_of_many_archives_and_odd_rows(spark):
    schema = "archive_id string, sequence long, op string, entry string, offset long, data binary, new_size long, new_name string"
    ops = spark.createDataFrame(
        [(f"z{i}", i, "WRITE", "a", 6, b"XY", None, None) for i in range(30)] + [(None, 1, "CREATE", "n", None, None, None, None), ("z1", 99, "WRITE", None, 0, b"q", None, None), ("z2", 99, "NOPE", "a", None, None, None, None), ("z3", 99, "WRITE", "a", 0, None, None, None)], schema
    )
    base = spark.createDataFrame([(f"z{i}", "a", b"0123456789" if i % 2 else None) for i in range(40)] + [(None, "x", b"1")], "archive_id string, name string, content binary")
    rows = session.replay(ops, base, page_size=4).collect()
    pages_ = {(r.archive_id, r.page_index): bytes(r.data) for r in rows if r.what == "page"}
    assert pages_ == {(f"z{i}", 1): b"45XY" for i in range(1, 30, 2)} and all(r.archive_id != "z35" for r in rows)
    assert {(r.archive_id, r.kind) for r in rows if r.what == "refused"} == {(f"z{i}", "Unsupported") for i in range(0, 30, 2)} | {("z1", "NotFound"), ("z2", "UnknownOp")}
    assert [r.name for r in rows if r.archive_id is None and r.what == "overlay"] == ["n"]
    assert session.replay(ops.limit(0), base).count() == 0


@pytest.mark.parametrize("settings", [{"coalescePartitions.minPartitionSize": "1k"}, {"coalescePartitions.minPartitionSize": "1k", "advisoryPartitionSizeInBytes": "4k", "autoBroadcastJoinThreshold": "-1"}])
def test_replay_of_inputs_dealt_by_archive(spark, tmp_path, settings):
    # operations and entries that are dealt by archive already, in partitions that Spark merges differently
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 9))
    spark.range(400).select(F.col("id").alias("conv_id"), turns.alias("turn")).write.parquet(f"{tmp_path}/conversations.parquet")
    held = {"spark.sql.shuffle.partitions": "40"} | {f"spark.sql.adaptive.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in registry.QUERIES["rename_chain_fold"](spark, str(tmp_path)).select("archive_id", "name", "kind", F.coalesce("source", F.lit("-"))).collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted((str(i), str(t), *(("Aliased", "0") if t == i % 9 else ("Tombstone", "-"))) for i in range(400) if i % 9 for t in range(i % 9 + 1))


def test_layouts_in_stretches_are_the_same(spark):
    from quireflow.operators import layout

    rows = [(None if i % 7 == 0 else f"s{i % 3}", i * 37 % 1000, str(i), "Kept" if i % 2 else "Created", i % 90, 5, 1000, i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, i long, name string, origin string, compressed_size long, modified int, file_size long, old_offset long").withColumn("modified", F.col("modified") == 5)
    for incremental in (False, True):
        whole, cut = (sorted(layout.commit_layout(df, ["s"], "i", incremental, stride=x).collect(), key=repr) for x in (None, 64))
        assert whole == cut and len(whole) == 400


def test_zip_source_reads_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    content = {f"n{i}": bytes([65 + i]) * (1000 * i) for i in range(6)}
    (tmp_path / "a.zip").write_bytes(archives.archive_image([(n, 0, c) for n, c in content.items()]))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    taken = []

    class Spy(archives.Ranged):
        def __getitem__(self, part):
            out = super().__getitem__(part)
            taken.append(len(out))
            return out

    reader = archives._ZipReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([archives.In(("name",), ("n1", "n2", "zz")), archives.EqualTo(("name",), "n2"), archives.EqualTo(("provider",), "Store")])) == [archives.EqualTo(("provider",), "Store")]
    monkeypatch.setattr(archives, "Ranged", Spy)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in rows] == ["n2"] and rows[0][13] == content["n2"] and sum(t >= 1000 for t in taken if t != len((tmp_path / "a.zip").read_bytes())) == 1
    archives.register(spark)
    got = spark.read.format("zipentries").load(f"file://{tmp_path}").where("name IN ('n3', 'n5')").collect()
    assert {(r.name, len(r.payload)) for r in got} == {("n3", 3000), ("n5", 5000)}
    assert {r.error for r in spark.read.format("zipentries").load(str(tmp_path)).collect()} == {None, "EocdNotFound"}


def test_codecs_that_are_registered_reach_the_executors(spark):
    from quireflow.functions import deflate

    try:
        deflate.register_codec(77, lambda data, offset, length, size, points=(): bytes(data)[::-1][offset : offset + length])
        df = spark.createDataFrame([(77, b"abc", 3), (78, b"abc", 3)], "method_code int, payload binary, uncompressed_size long")
        assert [None if r.content is None else bytes(r.content) for r in archives.with_content(df).orderBy("method_code").collect()] == [b"cba", None]
    finally:
        del deflate.CODECS[77]
