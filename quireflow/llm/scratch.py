"""Intermediate tables in the cluster's shared folder.

Iterative operators cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it back, so a lost executor never costs
more than one round. Where that setting is unset, a session in one process
(tests) gets a folder of its own, and any other is refused: its executors
could not read what one of them writes.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Input bytes for each file an intermediate table may have.
BYTES_A_FILE = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names, or one of our own if it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quireflow-"))
    return _own[0]


class Scratch:
    """Named tables of one operator call; ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession, label: str, source: DataFrame | None = None) -> None:
        self.spark = spark
        # Every file costs the store several calls, so a small input's tables get a few files a core at most;
        # the bound rises with the input, so that no task grows with it.
        size = 0 if source is None else int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.files = min(max(4 * spark.sparkContext.defaultParallelism, size // BYTES_A_FILE), 1_000_000)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.coalesce(self.files).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, hours: float) -> int:
    """Deletes the tables of calls that began more than so many hours ago; a result not yet written out still reads its own."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for s in fs.listStatus(root) if fs.exists(root) else ():
        if re.fullmatch(r"[a-z]+-[0-9a-f]{32}", s.getPath().getName()) and s.getModificationTime() < (time.time() - 3600 * hours) * 1000:
            gone += bool(fs.delete(s.getPath(), True))
    return gone
