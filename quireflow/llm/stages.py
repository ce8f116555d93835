"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Each works on whatever its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import decontamination, language_id, minhash_dedup, packing, secrets
from quireflow.llm.names import free
from quireflow.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in learned languages, mixed or not; texts that are null, hold no letter or fit no mixture better than noise does, go."""
    model = language_id.fit(docs.where(~language_id.fold(4, 2)))
    # the documents' own columns of such names are no predictions
    mine = [c for c in docs.columns if c.lower() in language_id.PREDICTED]
    aside = free([*docs.columns, *language_id.PREDICTED], *(f"own_{c}" for c in mine))
    told = language_id.predict(docs.withColumnsRenamed(dict(zip(mine, aside))), model).where((F.col("lang_pred") != "und") & (F.col("fit") >= 0))
    return told.drop(*language_id.PREDICTED).withColumnsRenamed(dict(zip(aside, mine))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (5-word shingles, similarity 0.8), that of the smallest doc_id; rows without an id stay.

    Of rows that repeat an id, which are one document, the one with the
    smallest values stays.
    """
    scratch = Scratch(spark, "stage", docs)
    found = scratch.keep(minhash_dedup.components(docs, width=5, percent=80).select("doc_id", "component_id"))
    (id_,) = free(docs.columns, "id")
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("rows"))
    again = scratch.keep(first.where("rows > 1").select(id_))
    kept = docs.join(first.where("rows = 1").select(id_), F.col("doc_id") == F.col(id_), "left_semi").unionByName(docs.where("doc_id IS NULL"))
    if again.isEmpty():
        return kept
    whole = docs.join(again, F.col("doc_id") == F.col(id_), "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    return kept.unionByName(whole.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's template with consistent slots."""
    marked = decontamination.mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("NOT contaminated").select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text by a mark and brings n_chars up to date; every row stays."""
    found = secrets.find_secrets(docs)
    text = secrets.redact(F.col("text"), F.col("secrets"))
    found = found.withColumn("text", F.when(F.size("secrets") > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document left."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark_leaks), ("secret scans", secret_spans), ("packing", pack)]
