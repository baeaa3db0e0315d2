"""A training corpus from ``documents`` in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import jaccard, language, lines, mixing, packing
from marginalia.llm.queries import tokenizer_file
from marginalia.llm.shared import materialise, table, written_order

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language has a probability under ``LEAST_SCORE``."""
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    scored = language.scored_documents(docs, model)
    return scored.where((F.col("_lang_pred") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; ``n_chars`` follows the text."""
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.when(F.col("_n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every class of near duplicates."""
    return jaccard.one_of_each_class(docs, materialise(jaccard.jaccard_classes(docs), "classes"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in an order that gives all sources equal shares, as long as they last. The order is that of the written rows."""
    return mixing.mix(docs).orderBy("_position").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences, whose ``sequence_id`` ascends in the order of the written documents."""
    return packing.pack_documents_in_order(written_order(docs.select("doc_id", "text"), "_place"), tokenizer_file(), "_place", added_tokens=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack", pack)]

#: Tokenisation, a trained classifier and chosen paths are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
