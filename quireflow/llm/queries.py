"""The queries the driver registers: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import decontamination, embedding_dedup, language_id, minhash_dedup, packing, preference, secrets, sharding, substring_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_spans(_read(spark, sf_dir, "documents"), k=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shuffle_into_shards(docs, shards=16)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    out = preference.format_pairs(conversations, preference.neighbour_pairs(conversations))
    spans = [F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(m) for m in ("chosen_mask", "rejected_mask")]
    return out.select("chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", *spans)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    kinds = F.transform(spans, lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.RULES)]
    joined = secrets.joined_spans(spans)
    return out.select("doc_id", *count, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.link_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.95)
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup.components(_read(spark, sf_dir, "documents"), width=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = language_id.fold(4, 2)
    model = language_id.fit(docs.where(~held))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_langs")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.mark_contaminated(docs, _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "item_ids")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held = language_id.fold(5, 0)
    models = toxicity.fit(docs, labels.where(~held))
    out = toxicity.score(docs, models)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sharding, op3_chat_formatting, op4_secret_scans, op5_embedding_dedup, op6_minhash_dedup, op7_language_id, op8_decontamination, op9_toxicity, op10_packing)}
