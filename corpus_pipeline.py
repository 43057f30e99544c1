"""The corpus pipeline: from documents to packed training sequences in five stages.

A stage is (name, function of (spark, docs, sf_dir)). Its result is written as Parquet and read again as the next one's
docs; all but the last return the columns of docs, whatever these are besides doc_id, text, lang and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.llm import langid, minhash, packing, pii, quality
from lodequery.llm.common import free_name, named, table, written

#: The least posterior probability of the predicted language.
MIN_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and are good with a posterior probability of at least one half.

    Null, empty and blank texts go; texts of any length are judged whole; repeated rows stay or go together; without rows,
    none. Columns of any name pass through.
    """
    return quality.good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found with enough certainty; a null lang becomes the language found.

    Null texts, texts without a letter, and all texts if no row has a lang, have none and go. Of languages that fit equally,
    the first in order is taken. Texts of any length are read whole; repeated rows stay or go together.
    """
    found = free_name(docs, "language")
    own = F.col(f"`{found}`")
    sure = langid.with_language(docs, langid.fit(docs), found).where((own["lang_pred"] != "und") & (own["score"] >= MIN_LANGUAGE_SCORE))
    return sure.select(*(F.coalesce("lang", own["lang_pred"]).alias("lang") if c == "lang" else named(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id; a null id comes after all others.

    Of rows with equal ids any one stays. Documents without words (null or blank texts) have no duplicates and stay, each row
    of them. Texts of any length are compared by their whole sets; without rows, none.
    """
    return minhash.one_of_each(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by labels; n_chars follows the text.

    Every row stays. A null text stays null and has a null n_chars; an empty one is unchanged. Where spans overlap, the first
    one's label stands for their union; of spans that start together, the kind listed first is the first.
    """
    redacted = pii.redact(docs)
    return redacted.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document stand in the packed sequences.

    A null or empty text is one piece with the end id alone; longer ones are cut into as many pieces as it takes; repeated rows
    and null ids are documents of their own; without rows, none.
    """
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]
#: Language identification and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
