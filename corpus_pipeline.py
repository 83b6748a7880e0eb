"""A corpus made ready for training: quality, near duplicates, benchmark passages, personal data, tokens.

Every stage but the last gives the columns that it got, and an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontaminate, neardup, pii, quality
from lexmill.llm._text import fresh, stash, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It is fitted on the labelled documents of sf_dir.

    A null text, an empty one and one without words go; nulls in other columns don't
    matter. Rows that repeat are judged alike. Long texts are judged whole.
    """
    return quality.keep_good(docs, quality.train(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Rows with a null doc_id, a null text or no words are in no group and stay. Of rows that
    repeat one stays. Long texts are compared whole.
    """
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark of sf_dir.

    Null and empty texts stay; rows that repeat are judged alike; long texts are searched
    whole; an empty benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(table(sf_dir, "benchmark")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kinds; n_chars, if there, follows.

    Null and empty texts stay as they are, and n_chars changes only where the text does,
    and stays null elsewhere. Rows that repeat are redacted alike; long texts
    are searched whole.
    """
    spans = fresh(docs, "pii_spans")
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip of each document.

    A null text has nulls, an empty one no tokens; a null doc_id stays null; rows that
    repeat have a row each. Long texts are encoded whole.
    """
    out = bpe.encode(docs.select("doc_id", "text"))
    return out.select("doc_id", "token_ids", "n_tokens", "round_trip")


STAGES = [
    ("quality classifier", keep_good_documents),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]

#: Trained trees, hashes and merges have no SQL: a brute-force version checks the pipeline in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written and read again by the next.

    An empty table gives an empty result. Columns beside doc_id and text may hold anything
    and have any names; those that operators use inside get others.
    """
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stash(docs, f"stage{n + 1}")
    return docs
