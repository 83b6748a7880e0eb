"""Sinks: blocks, processed documents, chunks, embeddings kept by fingerprint, and the search index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def processed_documents(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """A row for each document: document_info, table_of_contents and blocks, in order."""
    columns = ["block_idx", *(c for c in blocks.columns if c not in ("doc_id", "block_idx"))]
    body = blocks.groupBy("doc_id").agg(F.max("page").alias("total_pages"), F.array_sort(F.collect_list(F.struct(*columns))).alias("blocks"))
    entries = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("toc_idx", "page", "level", "header", "title"))).alias("table_of_contents"))
    rows = body.join(entries, "doc_id", "left")
    return rows.select("doc_id", F.struct("doc_id", "total_pages").alias("document_info"), "table_of_contents", "blocks")


def fingerprint(chunks: DataFrame, embedder: str) -> str:
    """Tells sets of chunks and embedders apart, whatever the order of rows."""
    row = chunks.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "content").cast("decimal(38,0)")).alias("s")).first()
    return f"{embedder}-{row['n']}-{row['s'] or 0}"


def embed_cached(chunks: DataFrame, embed: Callable[[DataFrame, str], DataFrame], root: str, embedder: str) -> DataFrame:
    """chunks with their embeddings, read where they were written before for the same chunks and embedder."""
    spark = chunks.sparkSession
    path = f"{root}/{fingerprint(chunks, embedder)}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        embed(chunks, "content").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


INDEX_SCHEMA = "id string, content string, headers string, page int, block_id bigint, embedding array<float>"


def ensure_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_SCHEMA}) USING parquet")


def add_to_index(chunks: DataFrame, name: str) -> None:
    """Append chunks under keys that depend on their content alone."""
    ensure_index(chunks.sparkSession, name)
    key = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "content"), 256)
    chunks.select(key.alias("id"), "content", "headers", F.col("page").cast("int"), F.col("id").cast("bigint").alias("block_id"), F.col("embedding").cast("array<float>")).write.insertInto(name)


def index_statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("total_documents"))


def drop_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
