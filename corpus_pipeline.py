"""From raw documents to packed training sequences: language, near duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that it is given, whole texts of any length. All but the
last return the columns of documents, further ones too, whatever their names; the last returns the packed pieces. Of
near duplicates and leaks it is ids that go: rows that share an id stay or go together, rows with a null id stay. Equal
texts under different ids are near duplicates, and the smallest id stays. Null and empty texts go with the
first stage, as no language can be told; a later stage that is given one keeps it. Without rows, a stage gives none; the
language model then learns nothing and rejects all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontam, langid, neardup, packing, pii
from lumenfold.llm.common import Workspace
from lumenfold.sources import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, learnt from the labelled ones, doesn't reject."""
    model = langid.train(docs)
    judged = "language"
    while judged in docs.columns:
        judged += "_"
    return docs.withColumn(judged, langid.language(model, F.col("text"))).where(~F.col(f"{judged}.rejected")).drop(judged)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, of a similarity of 0.8 or more, the document with the smallest id."""
    dropped = neardup.near_duplicates(docs, settings=neardup.Settings(percent=80)).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars counted anew."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

# Trained models, sketches and tokenizers can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
