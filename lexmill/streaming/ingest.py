"""Documents that arrive over time: the stateless operators on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.text import clean_text
from lexmill.operators.chunking import slide


def stream_chunks(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", most: int = 500) -> DataFrame:
    """Cleaned windows of the documents in Parquet files that are added to a folder."""
    docs = spark.readStream.schema(schema).parquet(path)
    return slide(docs.withColumn("text", clean_text(F.col("text"))), most=most)


def run_available(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now, each file once however often this is run."""
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
