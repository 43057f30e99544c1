"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, covertree, hmm, langid, merkle, minhash, packing, pii, quality, toxicity, warc
from .common import fold, table, written


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures are written once, without texts: the estimate and the verdicts both read them."""
    measured = written(quality.with_measures(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__quality"), "quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return quality.with_verdict(measured, quality.fit(measured)).select("doc_id", *(F.col("__quality")[n].alias(n) for n in names), "kept", "p_good")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.with_language(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "__language.lang_pred", "__language.score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.with_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__bpe.*")


def op4_embedding_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "__toxicity.score", "__toxicity.predicted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_embedding_cover_tree": op4_embedding_cover_tree,
    "op5_minhash": op5_minhash,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_hmm": op10_hmm,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
ORACLE_SQL: dict[str, str] = {"op8_chat_perspectives": chat.SQL, "op12_merkle_manifest": merkle.SQL}
