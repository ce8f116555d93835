"""Archives, seek indexes, journals and intents as DataFrames.

Whole files come through Spark's ``binaryFile`` reader, so any store Spark
reads will do, with one task a file and at most 2 GB a file. Archives of any
size are read by the ``zipentries`` data source, which seeks: it reads the
directory, then the headers and payloads of the entries that filters on the
name leave, in local folders and in the stores that Arrow's file systems open.
"""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from quireflow import schemas
from quireflow.functions.codecs import BadFormat, Index, Intent, walk_journal
from quireflow.functions.codes import METHOD_PROVIDER
from quireflow.functions.hashing import cd_hash_of
from quireflow.sources import zip_format as Z


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(df: DataFrame, parse, schema: str) -> DataFrame:
    """``parse(path, content)`` gives a file's rows; each file is one batch of its own."""
    names = [c.split()[0] for c in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = parse(path, content.as_buffer().to_pybytes() if content.is_valid else b"")
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

    return df.mapInArrow(run, schema)


def entry_rows(path: str, data, with_payload: bool = True, wanted=lambda name: True) -> list[dict]:
    """An archive's entries; one row with ``error`` if it can't be read, and an entry's own error beside it."""
    return list(each_entry(path, data, with_payload, wanted))


def each_entry(path: str, data, with_payload: bool = True, wanted=lambda name: True):
    """entry_rows() one at a time: of entries that aren't ``wanted`` by name nothing but the directory is read."""
    try:
        directory = Z.read_directory(data)
    except Z.ZipError as e:
        yield {"archive_id": path, "error": e.status}
        return
    for e in directory.entries:
        if not wanted(e.name):
            continue
        row = {k: getattr(e, k) for k in ("cd_ordinal", "name_bytes", "method_code", "flags", "crc32", "compressed_size", "uncompressed_size", "local_header_offset", "cd_record")}
        row |= {"archive_id": path, "name": e.name, "provider": METHOD_PROVIDER.get(e.method_code, "Unsupported")}
        try:
            row["data_offset"] = Z.data_offset(data, e)
            if with_payload:
                row["payload"] = bytes(Z.payload(data, e))
        except Z.ZipError as error:
            row["error"] = error.status
        yield row


def read_entries(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Entries of every archive at ``path`` (files, folders and globs), in columns of schemas.ENTRIES."""
    return _rows(_files(spark, path), lambda p, b: entry_rows(p, b, with_payload), schemas.ENTRIES)


def archive_row(path: str, data: bytes) -> dict:
    try:
        d = Z.read_directory(data)
    except Z.ZipError as e:
        return {"archive_id": path, "file_size": len(data), "error": e.status}
    return {"archive_id": path, "cd_offset": d.cd_offset, "cd_size": d.cd_size, "entry_count": len(d.entries), "cd_hash": cd_hash_of(Z.directory_block(data, d))} | d.bloat()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row an archive: sizes, bloat and fingerprint."""
    return _rows(_files(spark, path), lambda p, b: [archive_row(p, b)], schemas.ARCHIVES)


def journal_rows(path: str, data: bytes) -> list[dict]:
    """The valid prefix of a journal; one row with its ``status`` if the header can't be read or nothing follows it."""
    try:
        header, rows, stop = walk_journal(data)
    except BadFormat as e:
        return [{"archive_id": path, "status": e.status}]
    extra = {"archive_id": path, "page_size": header.page_size, "status": "Ok", "truncation_point": stop}
    return [r | extra for r in rows] or [extra | {"generation_id": header.generation_id}]


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_files(spark, path), journal_rows, schemas.JOURNAL)


def index_rows(path: str, data: bytes) -> list[dict]:
    try:
        index = Index(data)
    except BadFormat as e:
        return [{"archive_id": path, "error": e.status}]
    out = []
    for i in range(len(index)):
        try:
            e = index.entry(i)
            out.append({"archive_id": path, "entry_idx": i, "name": index.name(e)} | {k: v for k, v in e.__dict__.items() if k != "name_hash"} | {"name_hash": f"{e.name_hash:016x}"})
        except BadFormat as error:
            out.append({"archive_id": path, "entry_idx": i, "error": error.status})
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of seek indexes; a damaged file or record shows in ``error``."""
    return _rows(_files(spark, path), index_rows, schemas.INDEX_ENTRIES)


def checkpoint_rows(path: str, data: bytes) -> list[dict]:
    out = []
    try:
        index = Index(data)
        for i in range(len(index)):
            e = index.entry(i)
            for n, chunk in enumerate(index.chunks(e)):
                out += [{"archive_id": path, "entry_idx": i, "name": index.name(e), "chunk_ordinal": n, "provider": chunk.provider} | c.__dict__ for c in chunk.checkpoints]
    except BadFormat:
        return []  # a damaged index is rebuilt, not read in part
    return out


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_files(spark, path), checkpoint_rows, schemas.CHECKPOINTS)


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """Valid commit intents only: missing, torn and foreign ones count as absent."""

    def parse(p: str, b: bytes) -> list[dict]:
        intent = Intent.decode(b)
        return [] if intent is None else [{"archive_id": p} | intent.__dict__]

    return _rows(_files(spark, path), parse, "archive_id string, mode string, pre_size bigint, pre_cd_hash binary, post_size bigint, post_cd_hash binary")


class Ranged:
    """A file that is sliced like bytes; each slice is one read."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(self.size)
        if hi <= lo:
            return b""
        self.file.seek(lo)
        return self.file.read(hi - lo)


def _store(path: str):
    """(file system, path in it) of a local path or an address; s3a is what Hadoop calls s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.payload = options.get("payload", "true").lower() == "true"
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        out = []
        for p in self.paths:
            store, inner = _store(p)
            if store.get_file_info(inner).type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(inner))
                out += [_Archive(f"{p.rstrip('/')}/{f.base_name}") for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.lower().endswith(".zip")]
            else:
                out.append(_Archive(p))
        return out

    def read(self, partition):
        names = self.names
        store, inner = _store(partition.path)
        with store.open_input_file(inner) as f:
            for row in each_entry(partition.path, Ranged(f, f.size()), self.payload, lambda name: names is None or name in names):
                if names is None or row.get("name") in names:
                    yield tuple(row.get(c.split()[0]) for c in schemas.ENTRIES.split(", "))


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class _ZipWriter(DataSourceWriter):
    """A task writes its archives under temporary names; the commit renames all of them."""

    def __init__(self, options: dict, schema) -> None:
        self.root, self.names = options["path"], schema.names

    def write(self, iterator):
        at = {n: i for i, n in enumerate(self.names)}
        groups: dict[str, list] = {}
        for row in iterator:
            groups.setdefault(row[at["archive_id"]], []).append(row)
        os.makedirs(self.root, exist_ok=True)
        files = []
        for archive, rows in groups.items():
            rows.sort(key=lambda r: r[at["cd_ordinal"]] if "cd_ordinal" in at else 0)
            image = archive_image([(r[at["name"]], r[at["method_code"]] if "method_code" in at else 8, bytes(r[at["content"]] or b"")) for r in rows])
            final = os.path.join(self.root, os.path.basename(archive))
            tmp = f"{final}.{uuid.uuid4().hex}.tmp"
            with open(tmp, "wb") as f:
                f.write(image)
                f.flush()
                os.fsync(f.fileno())
            files.append((tmp, final))
        return _Written(files)

    def commit(self, messages) -> None:
        for m in messages:
            for tmp, final in m.files if m else ():
                os.replace(tmp, final)

    def abort(self, messages) -> None:
        for m in messages:
            for tmp, _ in m.files if m else ():
                if os.path.exists(tmp):
                    os.remove(tmp)


class ZipEntries(DataSource):
    """``spark.read.format("zipentries").load(path)``: path may list files and folders, by commas; option ``payload`` false leaves the bytes out.

    ``write_archives()`` writes through it: one file an archive_id, each in one task.
    """

    @classmethod
    def name(cls) -> str:
        return "zipentries"

    def schema(self) -> str:
        return schemas.ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ZipWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes ``zipentries`` known to the session, with filters on the name pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipEntries)


def with_content(entries: DataFrame) -> DataFrame:
    """Adds ``content``, decoded; null where the codec is unknown or the data corrupt."""
    from quireflow.functions.deflate import decoder

    return entries.withColumn("content", decoder()(F.col("method_code"), F.col("payload"), F.col("uncompressed_size")))


def archive_image(entries: list[tuple[str, int, bytes]]) -> bytes:
    """An archive of (name, method, content): STORE and DEFLATE are written, other methods as DEFLATE."""
    out = Z.Writer()
    for name, method, content in entries:
        out.add(Z.NewEntry(name.encode(), method if method in (0, 8) else 8, content))
    return out.finish()


def archive_images(entries: DataFrame) -> DataFrame:
    """(archive_id, image) of entries (archive_id, cd_ordinal, name, method_code, content): one row an archive, as large as the archive."""
    rows = entries.select("archive_id", "cd_ordinal", "name", "method_code", F.col("content").cast("binary").alias("content"))
    return folded(rows, "archive_id", ["cd_ordinal", "name"], "archive_id string, image binary", lambda key, own: [(key, archive_image([(n, m, c or b"") for _, n, m, c in own]))])


def folded(rows: DataFrame, key: str, order: list[str], schema: str, make) -> DataFrame:
    """What ``make(key, rows of that key in order)`` returns, key after key in sorted partitions; ``key`` is the first column."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches):
        arrow = to_arrow_schema(fields)
        held, last, began = [], None, False

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

        out: list[tuple] = []
        for batch in batches:
            for k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if began and k != last:
                    out += make(last, held)
                    held = []
                    if out:
                        yield done()
                        out = []
                last, began = k, True
                held.append(tuple(rest))
        if began:
            out += make(last, held)
        if out:
            yield done()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def parsed(images: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that ``parse(id, bytes)`` gives for each row (id, bytes); entry_rows(), index_rows(), journal_rows() and their kin will do."""
    return _rows(images, parse, schema)


def write_archives(entries: DataFrame, path: str) -> None:
    """Writes (archive_id, name, content; optional method_code and cd_ordinal) as one ZIP file an archive_id below ``path``."""
    register(entries.sparkSession)
    entries.repartition("archive_id").write.format("zipentries").mode("append").save(path)
