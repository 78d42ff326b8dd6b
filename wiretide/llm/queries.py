"""The numbered operators applied to their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, flac, langid, licenses, minhash, packing, secrets, suffixes, tokenfile, toxicity, vafile
from .oracles import oracle_sql as oracle_sql
from .store import read, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.text_features(table(flac.texts_to_flac(read(spark, sf_dir, "documents")), "flac"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(read(spark, sf_dir, "documents"), min_words=50).drop("uid")


def op3_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = toxicity.in_fold(5, 0)
    scored = toxicity.score(docs, toxicity.model(docs.where(~held_out), labels.where(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = toxicity.in_fold(4, 2)
    found = langid.predict(docs, langid.learn(docs.where(~held_out)))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n=5, threshold=0.8).drop("uid")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), size=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op8_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    stored = table(chat.render(chat.fold(chat.as_log(rows))), "transcripts")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.parse(stored).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select("doc_id", F.array_join(names, ",").alias("licences"), F.size("sentences").cast("long").alias("n_sentences"), F.size("matches").cast("long").alias("n_matches"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, number = F.col("label").cast("long"), F.col("vec_id").cast("long")
    own = vafile.vectors(read(spark, sf_dir, "embeddings"), F.when(number % 7 == 0, (label + 1) % 10).otherwise(label))
    return vafile.hard_negatives(own, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_flac_media, op2_suffix_dedup, op3_nnpu_toxicity, op4_kneser_ney_language, op5_token_planes, op6_minhash_join, op7_decontamination, op8_event_sourced_chat, op9_best_fit_packing, op10_license_rules, op11_token_alignment, op12_secret_scan, op13_hard_negatives]
    return {f.__name__: f for f in own}
