"""From raw documents to packed sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import common, language_id, mixing, packing, secrets, simhash

#: A document stays if this share or more of its words is in the predicted language.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language has its share, go; a missing lang is filled in.

    Null and empty texts have no letter and go; repeated rows are judged alike; without anything to learn from all stay;
    an empty table stays empty; columns are kept, whatever their names.
    """
    field = language_id.learn(docs, common.crc_mod("doc_id", 4) != 2)
    if not field.labels:  # nothing can be told apart
        return docs
    (found,) = common.unused(docs.columns, "found")
    lang = F.coalesce("lang", F.col(f"{found}.lang")).alias("lang")
    kept = (F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= LEAST_SCORE)
    return language_id.predict(docs, field, name=found).where(kept).select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: that with the least doc_id, or any if none has one.

    Rows go by their text, whatever their ids: those that share an id and are not linked stay. Null, empty and white texts
    are copies of one another; an empty table stays empty; columns are kept, whatever their names. Hashes of id and text
    (64 bits) are taken as unequal.
    """
    key, row = common.unused(docs.columns, "key", "row")
    kept = simhash.first_rows(docs).select(F.xxhash64("text_hash", "doc_id").alias(key))
    # rows with one id and text become one before they move, so a row that stands very often is no task's burden
    rows = docs.select(F.xxhash64(F.xxhash64("text"), "doc_id").alias(key), F.struct(*docs.columns).alias(row), "source", "lang", "n_chars")
    firsts = rows.groupBy(key).agg(F.min_by(row, F.struct("source", "lang", "n_chars")).alias(row))
    return firsts.join(kept, key, "left_semi").select(f"{row}.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, n_chars follows; every row stays.

    Null texts stay null, with the n_chars they have; repeated rows are redacted alike; an empty table stays empty;
    columns are kept, whatever their names.
    """
    (spans,) = common.unused(docs.columns, "spans")
    out = secrets.redact(secrets.scan(docs, spans=spans), spans=spans)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, or up to three times.

    Null, empty and white texts have no words and go; null sources are one source; rows that are equal in all columns
    stand in for one another, so a task that runs again changes nothing; an empty table stays empty; columns are kept.
    """
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens along the curve. Null texts are empty; repeated rows and null ids are documents of their
    own; an empty table gives no piece; other columns are ignored."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no field of words, fingerprints or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
