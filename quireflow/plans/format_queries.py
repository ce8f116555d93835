"""Queries that write bytes of the formats and read them back: archives, checkpoints, indexes, journals, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow import schemas
from quireflow.functions import codecs as C
from quireflow.functions import deflate, hashing
from quireflow.operators import lookup
from quireflow.plans.queries import _EV, _events, _query, _table
from quireflow.sources import archives

#: Documents of an archive, by their ids.
EACH = 64


def _archives(spark, sf_dir) -> DataFrame:
    """Documents as entries of small archives: even ids stored, odd ones deflated."""
    docs = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    method = F.when(F.col("doc_id") % 2 == 0, 0).otherwise(8)
    archive = F.concat_ws("-", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / EACH).cast("string"))
    return docs.select(archive.alias("archive_id"), F.col("doc_id").alias("cd_ordinal"), F.col("doc_id").cast("string").alias("name"), method.alias("method_code"), F.encode("text", "UTF-8").alias("content"))


_ARCHIVES = f"a AS (SELECT coalesce(source, 'none') || '-' || CAST(doc_id // {EACH} AS VARCHAR) AS archive_id, doc_id, CAST(doc_id AS VARCHAR) AS name, text, octet_length(encode(text)) AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


@_query(f"""WITH {_ARCHIVES} SELECT archive_id, name, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY doc_id) - 1 AS INTEGER) AS cd_ordinal, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 8 END AS method_code, n AS uncompressed_size, md5(text) AS digest,
CASE WHEN doc_id % 2 = 0 THEN n END AS stored_size FROM a""")
def zip_round_trip(spark, sf_dir):
    """Archives are written, and every entry is found by the directory, sliced and decoded."""
    images = archives.archive_images(_archives(spark, sf_dir))
    entries = archives.with_content(archives.parsed(images, archives.entry_rows, schemas.ENTRIES))
    return entries.select("archive_id", "name", "cd_ordinal", "method_code", "uncompressed_size", F.md5("content").alias("digest"), F.when(F.col("method_code") == 0, F.col("compressed_size")).alias("stored_size"))


@_query(f"""WITH {_ARCHIVES} SELECT archive_id, count(*) AS entry_count, CAST(sum(46 + length(name)) AS BIGINT) AS cd_size FROM a GROUP BY archive_id""")
def archive_directories(spark, sf_dir):
    images = archives.archive_images(_archives(spark, sf_dir))
    return archives.parsed(images, lambda p, b: [archives.archive_row(p, b)], schemas.ARCHIVES).select("archive_id", "entry_count", "cd_size")


def _index_image(path: str, data: bytes) -> list[dict]:
    from quireflow.plans.reader import Stat, build_index
    from quireflow.sources import zip_format as Z

    return [{"archive_id": path, "image": build_index(data, Z.read_directory(data), Stat(len(data), 0, 0), interval=4096)}]


@_query(f"""WITH {_ARCHIVES} SELECT archive_id, name, CASE WHEN doc_id % 2 = 0 THEN 'Store' ELSE 'Deflate' END AS provider, n AS uncompressed_size, count(*) OVER (PARTITION BY archive_id) AS entry_count FROM a""")
def index_records(spark, sf_dir):
    """Indexes with checkpoints are built from archives, written as bytes and read back."""
    indexes = archives.parsed(archives.archive_images(_archives(spark, sf_dir)), _index_image, "archive_id string, image binary")
    rows = archives.parsed(indexes, archives.index_rows, schemas.INDEX_ENTRIES)
    count = rows.groupBy("archive_id").agg(F.count("*").alias("entry_count"))
    return rows.join(count, "archive_id").select("archive_id", "name", "provider", "uncompressed_size", "entry_count")


@_query("""WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents WHERE octet_length(encode(text)) >= 20000),
r AS (SELECT doc_id, b, n, n * k // 7 AS o FROM d, unnest(range(0, 7)) AS t(k))
SELECT doc_id, o AS uncompressed_offset, md5(b[o + 1 : least(n, o + 300)]) AS digest FROM r""")
def checkpoint_reads(spark, sf_dir):
    """Ranges of deflated documents, each decoded from the last checkpoint before it."""
    n = F.octet_length("text").cast("long")
    docs = _table(spark, sf_dir, "documents").where(n >= 20_000).select("doc_id", n.alias("n"), deflate.deflate(F.encode("text", "UTF-8")).alias("packed"))
    points = docs.select("doc_id", F.inline(deflate.checkpointer(4096)(F.lit(8), "packed", "n")))
    reads = docs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.floor(F.col("n") * k / 7))).alias("uncompressed_offset"))
    found = lookup.as_of(reads, points, ["doc_id"], "uncompressed_offset", F.struct(F.col("uncompressed_offset").alias("u"), "compressed_offset", "bits", "window"), out="point")
    both = found.join(docs, "doc_id")
    length = F.least(F.lit(300).cast("long"), F.col("n") - F.col("uncompressed_offset"))
    bytes_ = deflate.resumer()("packed", "n", "uncompressed_offset", length, "point.u", "point.compressed_offset", "point.bits", "point.window")
    return both.select("doc_id", "uncompressed_offset", F.md5(bytes_).alias("digest"))


_GENERATION = bytes(range(16))


def _journal_image(log: int, rows: list[tuple]) -> list[tuple]:
    """One log's records as a journal file; every third log's last record is torn."""
    raw = C.JournalHeader(generation_id=_GENERATION, page_size=4096).encode()
    for sequence, kind, page in rows:
        if kind == "COMMIT":
            raw += C.encode_marker(_GENERATION, sequence, 0)
        elif kind == "META":
            raw += C.encode_meta(_GENERATION, sequence, "e", "RESIZE", page)
        else:
            raw += C.encode_data(_GENERATION, sequence, "e", page, b"%d" % sequence)
    return [(str(log), raw[: -3 if log % 3 == 0 else None])]


@_query(f"""WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY sequence DESC) = 1 AND log % 3 = 0 AS torn FROM ev WHERE event_type <> 'view' AND log IS NOT NULL)
SELECT CAST(log AS VARCHAR) AS archive_id, sequence, CASE event_type WHEN 'click' THEN 'DATA' WHEN 'purchase' THEN 'COMMIT' ELSE 'META' END AS kind, CASE event_type WHEN 'click' THEN k END AS page_index, CASE WHEN event_type IN ('signup', 'error') THEN k END AS new_size,
CASE event_type WHEN 'click' THEN CAST(sequence AS VARCHAR) END AS data, bool_or(torn) OVER (PARTITION BY log) AS truncated FROM r QUALIFY NOT torn""")
def journal_walk(spark, sf_dir):
    """Journals are written as bytes and walked to where they end or are torn."""
    e = _events(spark, sf_dir).where("log IS NOT NULL AND kind IS NOT NULL").select("log", "sequence", "kind", "page_index")
    images = archives.folded(e, "log", ["sequence"], "archive_id string, image binary", _journal_image)
    rows = archives.parsed(images, archives.journal_rows, schemas.JOURNAL).where("kind IS NOT NULL")
    return rows.select("archive_id", F.coalesce("sequence", "commit_sequence").alias("sequence"), "kind", "page_index", "new_size", F.decode("data", "UTF-8").alias("data"), F.col("truncation_point").isNotNull().alias("truncated"))


def _crc(polynomial: int, table: str, key: str, column: str, out: str) -> str:
    """A reflected CRC-32 in SQL: bytes folded one by one, each bit of the register's low byte adding its own term."""
    terms = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (polynomial if c & 1 else 0)
        terms.append(f"((xor(c, b) >> {bit}) & 1) * {c}")
    step = "c >> 8"
    for t in terms:
        step = f"xor({step}, {t})"
    return f"""WITH h AS (SELECT {key}, {column} IS NULL AS none, list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bs FROM {table})
SELECT {key}, CASE WHEN none THEN NULL ELSE xor(list_reduce(list_concat([4294967295], bs), lambda c, b: {step}), 4294967295) END AS {out} FROM h"""


@_query(_crc(0xEDB88320, "documents", "doc_id", "text", "crc32"))
def entry_crc32(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", hashing.crc32(F.encode("text", "UTF-8")).alias("crc32"))


@_query(_crc(0x82F63B78, "pages", "page_id", "html", "crc32c"))
def entry_crc32c(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", hashing.crc32c(F.encode("html", "UTF-8")).alias("crc32c"))


@_query()
def entry_hashes(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("d"))
    return p.select("page_id", hashing.name_hash("url").alias("name_hash"), F.hex(hashing.cd_hash("d")).alias("cd_hash"))
