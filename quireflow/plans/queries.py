"""The engine's operators over the driver's tables, each with its SQL; those on bytes of the formats are in format_queries.

A document is an entry and its UTF-8 bytes the uncompressed stream; an event
is a log record of its user's session: event_id the sequence, props.k the
page; click is a page write, view a read, signup CREATE, error REMOVE (or a
RESIZE to k pages), purchase a commit marker (or a RENAME). Labels are an overlay, pages of
the web are entries by name, conversation turns are chained names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow import schemas
from quireflow.functions import codes, geometry
from quireflow.operators import cache, journal, layout, lookup, overlay, pages, policy, session

PS = 4096
#: Pages a session may hold before it spills, in the spill query.
RESIDENT = 8
#: Width of the stretches of an archive's entries that one task lays out.
STRIDE = 1 << 20

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal rows of their user's log."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "click", "DATA").when(F.col("event_type").isin("signup", "error"), "META").when(F.col("event_type") == "purchase", "COMMIT")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("log"), F.col("event_id").alias("sequence"), F.col("event_id").alias("file_offset"), kind.alias("kind"), F.lit("e").alias("entry"), k.alias("page_index"), F.col("event_id").alias("commit_sequence"), "event_type", "ts", "value"
    )


_EV = "ev AS (SELECT user_id AS log, event_id AS sequence, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@_query(f"""SELECT doc_id, p AS page_index, p * {PS} AS page_start, CAST(least({PS}, n - p * {PS}) AS INT) AS page_len
FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), unnest(range(0, (n + {PS - 1}) // {PS})) AS t(p)""")
def page_split(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("d"))
    return pages.split(docs, "doc_id", "d", PS).drop("data")


@_query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, (octet_length(encode(text)) + 4095) // 4096 AS n_pages,
  CASE WHEN octet_length(encode(text)) = 0 THEN 0 ELSE octet_length(encode(text)) - ((octet_length(encode(text)) + 4095) // 4096 - 1) * 4096 END AS tail FROM documents WHERE text IS NOT NULL""")
def page_geometry(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    count = geometry.page_count(F.col("n"), PS)
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", n.alias("n")).select("doc_id", "n", count.alias("n_pages"), F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(geometry.page_length("n", count - 1, PS)).alias("tail"))


@_query(f"""WITH {_EV} SELECT v.log, v.sequence, c.sequence AS nearest FROM (SELECT * FROM ev WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON v.log = c.log AND v.sequence >= c.sequence""")
def nearest_checkpoint(spark, sf_dir):
    e = _events(spark, sf_dir)
    return lookup.as_of(e.where("event_type = 'view'").select("log", "sequence"), e.where("kind = 'DATA'").select("log", "sequence"), ["log"], "sequence", "sequence", stride=1 << 20)


@_query(f"""WITH {_EV}, m AS (SELECT log, max(sequence) AS s FROM ev WHERE event_type = 'purchase' GROUP BY log)
SELECT ev.log, ev.sequence, CASE WHEN event_type = 'click' THEN 'DATA' ELSE 'META' END AS kind, ev.sequence <= coalesce(m.s, 0) AS committed
FROM ev LEFT JOIN m USING (log) WHERE event_type IN ('click', 'signup', 'error')""")
def journal_classify(spark, sf_dir):
    return journal.classify(_events(spark, sf_dir), ["log"]).select("log", "sequence", "kind", "committed")


@_query(f"""WITH {_EV} SELECT log, k AS page_index, max(sequence) AS sequence, arg_max(value, sequence) AS value FROM ev WHERE event_type = 'click' GROUP BY log, k""")
def lww_pages(spark, sf_dir):
    return journal.live_pages(_events(spark, sf_dir), ["log"]).select("log", "page_index", "sequence", "value")


@_query(f"""WITH {_EV}, f AS (SELECT log, k AS page_index, min(sequence) AS stamp FROM ev WHERE event_type = 'click' GROUP BY log, k)
SELECT log, page_index, stamp, row_number() OVER (PARTITION BY log ORDER BY stamp DESC, page_index) > {RESIDENT} AS spilled FROM f""")
def spill_fifo(spark, sf_dir):
    return journal.spill(_events(spark, sf_dir), ["log"], RESIDENT).select("log", "page_index", "stamp", "spilled")


@_query(f"""WITH {_EV} SELECT log, count(*) AS records, count(DISTINCT k) AS live, count(*) - count(DISTINCT k) AS dead, count(*) - count(DISTINCT k) > count(DISTINCT k) AS should_compact FROM ev WHERE event_type = 'click' GROUP BY log""")
def journal_dead_live(spark, sf_dir):
    return journal.space(_events(spark, sf_dir), ["log"])


@_query(f"""WITH {_EV} SELECT log, greatest(coalesce(octet_length(encode(any_value(d.text))), 0), max(k * {PS} + CAST(floor(value) AS BIGINT) % {PS})) AS logical_size
FROM ev LEFT JOIN documents d ON d.doc_id = ev.log WHERE event_type = 'click' GROUP BY log""")
def logical_size(spark, sf_dir):
    e = _events(spark, sf_dir).where("kind = 'DATA'")
    end = e.groupBy("log").agg(F.max(F.col("page_index") * PS + F.floor("value") % PS).alias("e"))
    base = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("log"), F.octet_length("text").cast("long").alias("base"))
    return end.join(base, "log", "left").select("log", journal.logical_size(F.coalesce("base", F.lit(0).cast("long")), F.col("e")).alias("logical_size"))


@_query(f"""WITH {_EV} SELECT d.doc_id, least(octet_length(encode(d.text)), coalesce(r.m, octet_length(encode(d.text)))) AS source_size
FROM documents d JOIN (SELECT DISTINCT log FROM ev) l ON l.log = d.doc_id LEFT JOIN (SELECT log, min(k * {PS}) AS m FROM ev WHERE event_type = 'error' GROUP BY log) r ON r.log = d.doc_id""")
def source_high_water(spark, sf_dir):
    e = _events(spark, sf_dir)
    least = e.groupBy(F.col("log").alias("doc_id")).agg(F.min(F.when(F.col("event_type") == "error", F.col("page_index") * PS)).alias("m"))
    n = F.octet_length("text").cast("long")
    return _table(spark, sf_dir, "documents").join(least, "doc_id").select("doc_id", journal.source_high_water(n, F.col("m")).alias("source_size"))


@_query("""WITH probe AS (SELECT url AS name FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url || '#absent' FROM pages WHERE page_id % 7 = 0)
SELECT DISTINCT probe.name, p.url IS NOT NULL AS found FROM probe LEFT JOIN pages p ON p.url = probe.name""")
def name_lookup(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    probe = p.where("page_id % 3 = 0").select(F.col("url").alias("name")).union(p.where("page_id % 7 = 0").select(F.concat("url", F.lit("#absent"))))
    return lookup.by_name(probe, p.select(F.col("url").alias("name")).distinct()).distinct()


_OV = "ov AS (SELECT doc_id AS name, CASE WHEN toxic = 1 THEN 'Tombstone' WHEN quality = 0 THEN 'Aliased' ELSE 'Created' END AS kind FROM labels WHERE doc_id IS NOT NULL)"


def _overlay(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "Tombstone").when(F.col("quality") == 0, "Aliased").otherwise("Created")
    return _table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("name"), kind.alias("kind"), F.when(kind == "Aliased", F.col("doc_id")).alias("source"))


@_query(f"""WITH {_OV} SELECT doc_id AS name, CASE ov.kind WHEN 'Tombstone' THEN 'Absent' WHEN 'Created' THEN 'Created' ELSE 'Source' END AS kind FROM documents LEFT JOIN ov ON ov.name = doc_id""")
def entry_kind(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.octet_length("text").cast("long").alias("uncompressed_size"), F.lit("Deflate").alias("provider"))
    return overlay.resolve(docs.select("name"), _overlay(spark, sf_dir), docs).select("name", "kind")


@_query(f"""WITH {_OV}, ix AS (SELECT doc_id AS name, octet_length(encode(text)) AS n, CASE doc_id % 5 WHEN 0 THEN 'Store' WHEN 1 THEN 'Unsupported' ELSE 'Deflate' END AS provider FROM documents WHERE doc_id % 3 <> 0),
al AS (SELECT name, kind, CASE WHEN kind = 'Aliased' THEN name + 1 END AS source FROM ov),
r AS (SELECT d.doc_id AS name, CASE WHEN al.kind = 'Tombstone' THEN 'Absent' WHEN al.kind = 'Created' THEN 'Created' WHEN al.kind = 'Aliased' OR own.name IS NOT NULL THEN 'Source' ELSE 'Absent' END AS kind, coalesce(al.source, d.doc_id) AS target
  FROM documents d LEFT JOIN al ON al.name = d.doc_id LEFT JOIN ix own ON own.name = d.doc_id)
SELECT r.name, r.kind, CASE WHEN r.kind = 'Source' THEN target END AS source_name, CASE WHEN r.kind = 'Absent' OR r.kind = 'Source' AND s.name IS NULL THEN 'NotFound' WHEN r.kind = 'Source' AND s.provider = 'Unsupported' THEN 'Unsupported' ELSE 'Ok' END AS status,
  CASE WHEN r.kind = 'Created' THEN 0 WHEN r.kind = 'Source' THEN s.n END AS original_size FROM r LEFT JOIN ix s ON r.kind = 'Source' AND s.name = r.target""")
def overlay_resolve(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.octet_length("text").cast("long").alias("uncompressed_size"))
    kind = F.when(F.col("name") % 5 == 0, "Store").when(F.col("name") % 5 == 1, "Unsupported").otherwise("Deflate")
    index = docs.where("name % 3 <> 0").withColumn("provider", kind)
    # an alias has the bytes of the entry after it
    moved = _overlay(spark, sf_dir).withColumn("source", F.when(F.col("kind") == "Aliased", F.col("name") + 1))
    return overlay.resolve(docs.select("name"), moved, index).select("name", "kind", "source_name", "status", "original_size")


@_query(f"""WITH {_OV} SELECT doc_id AS name, 'Kept' AS origin FROM documents WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.name = doc_id) UNION ALL SELECT name, kind FROM ov WHERE kind <> 'Tombstone'""")
def effective_set(spark, sf_dir):
    return overlay.effective(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), _overlay(spark, sf_dir)).select("name", "origin")


@_query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def dirty_semi(spark, sf_dir):
    return overlay.edited(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), _overlay(spark, sf_dir)).select(F.col("name").alias("doc_id"))


@_query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def clean_anti(spark, sf_dir):
    return overlay.unedited(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), _overlay(spark, sf_dir)).select(F.col("name").alias("doc_id"))


@_query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 3 = 0 THEN 2 WHEN html IS NOT NULL THEN 3 ELSE 0 END AS tier,
  md5(CASE WHEN page_id % 5 = 0 THEN 'one' || page_id WHEN page_id % 3 = 0 THEN 'two' || page_id ELSE html END) AS digest FROM pages""")
def three_tier_resolve(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    tag = lambda word: F.encode(F.concat(F.lit(word), F.col("page_id").cast("string")), "UTF-8").alias("data")
    one, two = p.where("page_id % 5 = 0").select("page_id", tag("one")), p.where("page_id % 3 = 0").select("page_id", tag("two"))
    three = p.where("html IS NOT NULL").select("page_id", F.encode("html", "UTF-8").alias("data"))
    return pages.resolve_tiers(p.select("page_id"), one, two, three, ["page_id"]).select("page_id", "tier", F.md5("data").alias("digest"))


@_query(f"""WITH w AS (SELECT item_id AS doc_id, item_id * 1000 AS o, octet_length(encode(text)) AS n FROM benchmark),
p AS (SELECT doc_id, p AS page_index, p * {PS} AS s, (p + 1) * {PS} AS e FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents), unnest(range(0, (n + {PS - 1}) // {PS})) AS t(p))
SELECT w.doc_id, page_index, greatest(o, s) - s AS in_page, greatest(o, s) - o AS in_write, least(o + n, e) - greatest(o, s) AS n FROM w JOIN p ON w.doc_id = p.doc_id AND o < e AND s < o + n""")
def write_page_overlap(spark, sf_dir):
    writes = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), (F.col("item_id") * 1000).alias("offset"), F.octet_length("text").cast("long").alias("length"))
    cut = page_split(spark, sf_dir).select("doc_id", "page_index")
    return lookup.overlapping(writes, cut, ["doc_id"], PS).select("doc_id", "page_index", "in_page", "in_write", "n")


@_query("""WITH r AS (SELECT doc_id, 1000 AS o, 5000 AS k, octet_length(encode(text)) AS n, encode(text) AS b FROM documents)
SELECT doc_id, CASE WHEN o + k <= n THEN 'Ok' ELSE 'OutOfRange' END AS status, CASE WHEN o + k <= n THEN md5(b[o + 1 : o + k]) END AS digest FROM r""")
def range_read(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("d"))
    reads = docs.select("doc_id", F.lit(1000).cast("long").alias("offset"), F.lit(5000).cast("long").alias("length"))
    return pages.read(docs, reads, "doc_id", "d").select("doc_id", "status", F.md5("bytes").alias("digest"))


@_query(f"""WITH r AS (SELECT doc_id, n_chars % 3000 AS o, 9000 AS k FROM documents WHERE n_chars IS NOT NULL) SELECT doc_id, p AS page_index FROM r, unnest(range(o // {PS}, (o + k - 1) // {PS} + 1)) AS t(p)""")
def range_read_pages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("n_chars IS NOT NULL")
    return docs.select("doc_id", F.explode(geometry.touched(F.col("n_chars") % 3000, F.lit(9000), PS)).alias("page_index"))


@_query(f"""SELECT doc_id, greatest(0, least({PS}, n_chars - {PS})) AS second_page FROM documents""")
def tail_clamp(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", geometry.tail_length("n_chars", F.lit(1), PS).alias("second_page"))


_BLOAT = """b AS (SELECT source, sum(octet_length(encode(text))) AS file_size, sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE octet_length(encode(text)) END) AS live FROM documents GROUP BY source)"""


def _bloat(spark, sf_dir) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("file_size"), F.sum(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(n)).alias("live"))


@_query(f"WITH {_BLOAT} SELECT source, CAST(file_size AS BIGINT) AS file_size, CAST(live AS BIGINT) AS live, CAST(greatest(0, file_size - live) AS BIGINT) AS bloat_bytes, CASE WHEN live = 0 THEN 1.0 ELSE CAST(file_size AS DOUBLE) / live END AS bloat_ratio FROM b")
def bloat(spark, sf_dir):
    b = _bloat(spark, sf_dir)
    return b.select("source", "file_size", "live", F.greatest(F.lit(0).cast("long"), F.col("file_size") - F.col("live")).alias("bloat_bytes"), policy.bloat_ratio(F.col("file_size"), F.col("live")).alias("bloat_ratio"))


@_query(f"WITH {_BLOAT} SELECT source, CASE WHEN file_size % 5 = 0 THEN 'Noop' WHEN (CASE WHEN live = 0 THEN 1.0 ELSE CAST(file_size AS DOUBLE) / live END) >= 1.5 THEN 'Full' ELSE 'Incremental' END AS mode FROM b")
def commit_policy(spark, sf_dir):
    b = _bloat(spark, sf_dir)
    ratio = policy.bloat_ratio(F.col("file_size"), F.col("live"))
    return b.select("source", policy.commit_mode(F.col("file_size") % 5 != 0, policy.should_full(ratio, F.col("file_size") - F.col("live"), threshold=1.5)).alias("mode"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Invalid' WHEN doc_id % 3 = 0 THEN 'ValidStale' ELSE 'Valid' END AS verdict FROM documents""")
def fingerprint_verdict(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    live = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("h", F.lit("x"))).otherwise(F.col("h")).alias("lh"), (F.col("n") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("ln"))
    return docs.join(live, "doc_id").select("doc_id", policy.fingerprint_verdict(F.col("h"), F.col("lh"), F.col("n") == F.col("ln"), F.lit(True)).alias("verdict"))


@_query("""SELECT event_id, CASE m WHEN 0 THEN 'Store' WHEN 8 THEN 'Deflate' WHEN 93 THEN 'Zstd' ELSE 'Unsupported' END AS provider, CASE m WHEN 0 THEN 0 WHEN 8 THEN 1 WHEN 93 THEN 3 ELSE 255 END AS code, CASE m WHEN 8 THEN 32785 WHEN 93 THEN 16 END AS record_size
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 8 WHEN 'view' THEN 0 WHEN 'purchase' THEN 93 ELSE 12 END AS m FROM events)""")
def method_provider(spark, sf_dir):
    m = F.when(F.col("event_type") == "click", 8).when(F.col("event_type") == "view", 0).when(F.col("event_type") == "purchase", 93).otherwise(12)
    provider = codes.provider_of_method(F.col("m"))
    return _table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", provider.alias("provider"), codes.provider_code(provider).alias("code"), codes.record_size(provider).alias("record_size"))


@_query("""SELECT source, doc_id, CAST(coalesce(sum(octet_length(encode(text)) + 30 + length(CAST(doc_id AS VARCHAR))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_header_offset FROM documents""")
def cd_offsets(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("name"), F.octet_length("text").cast("long").alias("compressed_size"))
    return layout.commit_layout(docs, ["source"], "doc_id", stride=STRIDE).select("source", "doc_id", "local_header_offset")


@_query("""SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS entry_idx FROM documents""")
def index_sorted(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("name"))
    return layout.index_layout(docs, ["source"], F.md5("name")).select("source", "doc_id", "entry_idx")


@_query(f"""WITH {_EV}, m AS (SELECT log, coalesce(max(CASE WHEN event_type = 'purchase' THEN sequence END), 0) AS s, count(*) FILTER (event_type IN ('click', 'signup', 'error')) AS n FROM ev GROUP BY log)
SELECT log, CASE WHEN log % 11 = 0 THEN 'Abort' WHEN n = 0 AND s = 0 THEN 'Discard' WHEN s > 0 THEN 'RecoverCommitted' ELSE 'Abort' END AS decision FROM m""")
def recovery_decision(spark, sf_dir):
    s = journal.summary(_events(spark, sf_dir), ["log"])
    empty = (F.col("committed") + F.col("uncommitted") == 0) & (F.col("last_commit_seq") == 0)
    return s.select("log", policy.recovery_decision(F.lit("Ok"), F.col("log") % 11 == 0, empty, F.col("last_commit_seq")).alias("decision"))


@_query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), m AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM t GROUP BY conv_id HAVING count(*) > 1)
SELECT CAST(conv_id AS VARCHAR) AS archive_id, CAST(turn AS VARCHAR) AS name, CASE WHEN turn = hi THEN 'Aliased' ELSE 'Tombstone' END AS kind, CASE WHEN turn = hi THEN CAST(lo AS VARCHAR) END AS source FROM t JOIN m USING (conv_id)""")
def rename_chain_fold(spark, sf_dir):
    # a conversation's first turn is an entry that is renamed from turn to turn; each link is an operation of its own
    turns = _table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("string").alias("archive_id"), "turn").distinct()
    following = F.lead("turn").over(Window.partitionBy("archive_id").orderBy("turn"))
    ops = _ops(turns.withColumn("next", following).where("next IS NOT NULL"), op=F.lit("RENAME"), sequence=F.col("turn"), entry=F.col("turn").cast("string"), new_name=F.col("next").cast("string"))
    base = turns.groupBy("archive_id").agg(F.min("turn").cast("string").alias("name")).withColumn("content", F.lit(b"x"))
    return session.replay(ops, base).where("what = 'overlay'").select("archive_id", "name", "kind", "source")


@_query("SELECT doc_id, md5(text) AS digest FROM documents WHERE octet_length(encode(text)) > 0")
def page_assemble(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("d"))
    return pages.assemble(pages.split(docs, "doc_id", "d", PS), "doc_id").select("doc_id", F.md5("content").alias("digest"))


@_query(f"""WITH w AS (SELECT b.item_id AS doc_id, encode(b.text) AS piece, encode(d.text) AS t FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
r AS (SELECT doc_id, piece, t, octet_length(t) AS n, octet_length(piece) AS k FROM w WHERE octet_length(t) >= 100 + octet_length(piece))
SELECT doc_id, md5(t[1 : 100] || piece || t[100 + k + 1 : n]) AS digest FROM r""")
def page_patch(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.encode("text", "UTF-8").alias("piece"))
    d = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("t"))
    both = d.join(b, "doc_id").where(F.octet_length("t") >= 100 + F.octet_length("piece"))
    return both.select("doc_id", F.md5(pages.patch(F.col("t"), F.lit(100), F.col("piece"))).alias("digest"))


@_query(f"""WITH {_EV} SELECT log, count(*) FILTER (event_type = 'click') AS data_records, count(DISTINCT CASE WHEN event_type = 'click' THEN k END) * {PS} AS dirty_bytes, max(CASE WHEN event_type IN ('click', 'signup', 'error') THEN sequence END) AS last_sequence,
 8 * count(DISTINCT k) + 8 + 24 * count(*) AS advisory_size, 36 + 24 * count(DISTINCT k) AS chunk_length FROM ev GROUP BY log""")
def session_counters(spark, sf_dir):
    e = _events(spark, sf_dir)
    page = F.when(F.col("kind") == "DATA", F.col("page_index"))
    each = e.groupBy("log").agg(F.count_if(F.col("kind") == "DATA").alias("data_records"), (F.count_distinct(page) * PS).alias("dirty_bytes"), F.max(F.when(F.col("kind").isin("DATA", "META"), F.col("sequence"))).alias("last_sequence"), F.count_distinct("page_index").alias("n"), F.count("*").alias("m"))
    return each.select("log", "data_records", "dirty_bytes", "last_sequence", codes.advisory_size("n", "m").alias("advisory_size"), codes.chunk_length(F.lit("DeflateVmm"), "n").cast("long").alias("chunk_length"))


_VIEWS = f"WITH {_EV}, v AS (SELECT log, sequence, k, row_number() OVER (PARTITION BY log ORDER BY sequence) AS i FROM ev WHERE event_type = 'view')"


# a read is a hit if fewer than 8 other pages were read since the last time
@_query(f"""{_VIEWS}, p AS (SELECT *, lag(i) OVER (PARTITION BY log, k ORDER BY i) AS prev FROM v),
h AS (SELECT p.log, p.i, (SELECT count(DISTINCT w.k) FROM v w WHERE w.log = p.log AND w.i > p.prev AND w.i < p.i) AS between_ FROM p WHERE prev IS NOT NULL),
n AS (SELECT log, count(*) AS total, least(8, count(DISTINCT k)) AS resident FROM v GROUP BY log), c AS (SELECT log, count(*) AS hits FROM h WHERE between_ < 8 GROUP BY log)
SELECT n.log, coalesce(hits, 0) AS hits, total - coalesce(hits, 0) AS misses, resident, resident * {PS} AS resident_bytes FROM n LEFT JOIN c USING (log)""")
def lru_cache_sim(spark, sf_dir):
    reads = _events(spark, sf_dir).where("event_type = 'view'")
    return cache.simulate(reads, "log", "sequence", "entry", "page_index", total=100, page_bytes=PS, cache_bytes=8 * PS)


# held pages as a list, the one used last at its end
@_query(f"""WITH RECURSIVE {_VIEWS[5:]}, r(log, i, held, hits) AS (
SELECT DISTINCT log, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM v
UNION ALL SELECT r.log, v.i,
  CASE WHEN list_contains(held, k) THEN list_append(list_filter(held, lambda x: x <> k), k)
       ELSE list_concat(held, range(k, coalesce(list_min(list_filter(range(k + 1, least(k + 9, 100)), lambda x: list_contains(held, x))), least(k + 9, 100))))[-64:] END,
  hits + CASE WHEN list_contains(held, k) THEN 1 ELSE 0 END
FROM r JOIN v ON v.log = r.log AND v.i = r.i + 1)
SELECT log, hits, i - hits AS misses, CAST(len(held) AS BIGINT) AS resident, CAST(len(held) * {PS} AS BIGINT) AS resident_bytes FROM r QUALIFY row_number() OVER (PARTITION BY log ORDER BY i DESC) = 1""")
def read_ahead_sim(spark, sf_dir):
    reads = _events(spark, sf_dir).where("event_type = 'view'")
    return cache.simulate(reads, "log", "sequence", "entry", "page_index", total=100, page_bytes=PS, cache_bytes=64 * PS, ahead=geometry.READ_AHEAD)


@_query("SELECT page_id, true AS same, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM pages WHERE html IS NOT NULL")
def deflate_round_trip(spark, sf_dir):
    from quireflow.functions import deflate

    p = _table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.encode("html", "UTF-8").alias("d"))
    n = F.octet_length("d").cast("long")
    return p.select("page_id", (deflate.decoder()(F.lit(8), deflate.deflate("d"), n) == F.col("d")).alias("same"), n.alias("n"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'DropJournal' WHEN doc_id % 6 = 1 THEN 'Keep' WHEN doc_id % 6 = 2 THEN 'Truncate' ELSE 'Leave' END AS action FROM documents""")
def intent_recovery(spark, sf_dir):
    r = F.col("doc_id") % 6
    state = F.when(r == 0, "post").when(r == 1, "pre").otherwise("neither")
    return _table(spark, sf_dir, "documents").select("doc_id", policy.intent_action(F.when(r == 3, "FULL").otherwise("INCREMENTAL"), state, r <= 3).alias("action"))


def _ops(rows: DataFrame, **own) -> DataFrame:
    """Rows with an archive_id as schemas.OPS, what is not given null."""
    return rows.select(*[own.get(c, F.col(c) if c == "archive_id" else F.lit(None).cast(t)).cast(t).alias(c) for c, t in (x.split() for x in schemas.OPS.split(", "))])


def session_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events as operations on two names of their user's document: e, which it is, and f, which it may be renamed to and from."""
    e = _events(spark, sf_dir).where("log IS NOT NULL AND event_type <> 'view'").withColumn("archive_id", F.col("log").cast("string"))
    odd = F.col("page_index") % 2 == 1
    op = F.when(F.col("kind") == "DATA", "WRITE").when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", F.when(odd, "REMOVE").otherwise("RESIZE")).otherwise("RENAME")
    entry = F.when((op != "RENAME") & (F.col("sequence") % 3 == 0) | (op == "RENAME") & odd, "f").otherwise("e")
    ops = _ops(e, sequence=F.col("sequence"), op=op, entry=entry, offset=F.col("page_index") * 64 + 7, data=F.encode(F.concat_ws(":", "sequence", F.lit("abcdefgh" * 9)), "UTF-8"), new_size=F.col("page_index") * 64 + 5, new_name=F.when(entry == "e", "f").otherwise("e"))
    base = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("archive_id"), F.lit("e").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return ops, base


@_query()
def session_replay(spark, sf_dir):
    ops, base = session_log(spark, sf_dir)
    return session.replay(ops, base, page_size=64, limit=16 * 64).select("archive_id", "what", "name", "kind", "source", "logical_size", "source_size", "page_index", "stamp", "tier", F.md5("data").alias("digest"), "sequence")


_LOG = f"WITH {_EV}, d AS (SELECT CAST(doc_id AS VARCHAR) AS archive_id, octet_length(encode(text)) AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


@_query(f"""{_LOG}, t AS (SELECT CAST(log AS VARCHAR) AS archive_id, arg_max(k * 100, sequence) AS last, min(k * 100) AS least FROM ev WHERE event_type = 'error' GROUP BY log)
SELECT archive_id, last AS logical_size, least(n, least) AS source_size FROM t JOIN d USING (archive_id)""")
def truncate_sizes(spark, sf_dir):
    """Resizes only: the last one gives the size, the smallest how far the source still counts."""
    e = _events(spark, sf_dir).where("log IS NOT NULL AND event_type = 'error'").withColumn("archive_id", F.col("log").cast("string"))
    ops = _ops(e, sequence=F.col("sequence"), op=F.lit("RESIZE"), entry=F.lit("e"), new_size=F.col("page_index") * 100)
    _, base = session_log(spark, sf_dir)
    return session.replay(ops, base.where("content IS NOT NULL")).where("what = 'entry'").select("archive_id", "logical_size", "source_size")


@_query(f"""WITH {_EV}, o AS (SELECT CAST(log AS VARCHAR) AS archive_id, sequence, event_type = 'signup' AS makes, lag(event_type = 'signup', 1, false) OVER (PARTITION BY log ORDER BY sequence) AS there FROM ev WHERE event_type IN ('signup', 'error') AND log IS NOT NULL)
SELECT archive_id, CASE arg_max(makes, sequence) WHEN true THEN 'Created' ELSE 'Tombstone' END AS kind, count(*) FILTER (makes AND there) AS exists_, count(*) FILTER (NOT makes AND NOT there) AS not_found FROM o GROUP BY archive_id HAVING bool_or(makes)""")
def create_remove(spark, sf_dir):
    """Creations and removals of one name: each that changes nothing is refused."""
    e = _events(spark, sf_dir).where("log IS NOT NULL AND event_type IN ('signup', 'error')").withColumn("archive_id", F.col("log").cast("string"))
    ops = _ops(e, sequence=F.col("sequence"), op=F.when(F.col("event_type") == "signup", "CREATE").otherwise("REMOVE"), entry=F.lit("new"))
    _, base = session_log(spark, sf_dir)
    rows = session.replay(ops, base)
    refused = lambda kind: F.count_if((F.col("what") == "refused") & (F.col("kind") == kind))
    out = rows.groupBy("archive_id").agg(F.max(F.when(F.col("what") == "overlay", F.col("kind"))).alias("kind"), refused("Exists").alias("exists_"), refused("NotFound").alias("not_found"))
    return out.where("kind IS NOT NULL")


@_query("""WITH e AS (SELECT source, CAST(doc_id AS VARCHAR) AS name, doc_id, octet_length(encode(text)) AS n FROM documents),
r AS (SELECT source, name, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY md5(name), name) - 1 AS entry_idx,
  coalesce(sum(length(name)) OVER (PARTITION BY source ORDER BY md5(name), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS name_offset FROM e)
SELECT source, name, entry_idx, CAST(name_offset AS BIGINT) AS name_offset, 128 + 96 * entry_idx AS record_offset FROM r""")
def index_layout(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("name"))
    return layout.index_layout(rows, ["source"], F.md5("name")).select("source", "name", "entry_idx", "name_offset", "record_offset")


_EFF = """eff AS (SELECT source, CAST(doc_id AS VARCHAR) AS name, doc_id, doc_id * 1000 AS old_offset, 1000000 AS file_size, octet_length(encode(text)) AS n, doc_id % 4 = 0 AS ch FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT *, CASE WHEN ch THEN 30 + length(name) + n ELSE 0 END AS app FROM eff)"""


@_query(f"""WITH {_EFF} SELECT source, name, ch AS changed, CAST(app AS BIGINT) AS appended,
CAST(CASE WHEN ch THEN 1000000 + coalesce(sum(app) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE old_offset END AS BIGINT) AS local_header_offset FROM b""")
def commit_layout(spark, sf_dir):
    out = layout.commit_layout(_effective(spark, sf_dir), ["source"], "doc_id", incremental=True, stride=STRIDE)
    return out.select("source", "name", "changed", "appended", "local_header_offset")


@_query(f"""WITH {_EFF} SELECT source, CAST(sum(app) AS BIGINT) AS body_bytes, CAST(sum(46 + length(name)) + 22 AS BIGINT) AS directory_bytes, count(*) FILTER (ch) AS changed FROM b GROUP BY source""")
def commit_size(spark, sf_dir):
    return layout.commit_size(layout.commit_layout(_effective(spark, sf_dir), ["source"], "doc_id", incremental=True, stride=STRIDE), ["source"])


def _effective(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    return docs.select(
        "source", "doc_id", F.col("doc_id").cast("string").alias("name"), F.lit("Kept").alias("origin"), (F.col("doc_id") % 4 == 0).alias("modified"), F.octet_length("text").cast("long").alias("compressed_size"), F.lit(1_000_000).cast("long").alias("file_size"), (F.col("doc_id") * 1000).alias("old_offset")
    )
