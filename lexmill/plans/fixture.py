"""Inputs for the queries, derived from the tables by arithmetic in both dialects.

documents has no headings, references or page layout. Its lines become blocks here, and
what they lack is added by position, so that every operator has something to do.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PAGE = 4
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block_idx, page, bbox, height, text)"""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "line"))
    i, d, line = F.col("block_idx"), F.col("doc_id"), F.col("line")
    k = F.floor(i / 3 + 1).cast("int").cast("string")
    m = (i + d) % 12
    bare = F.regexp_replace(line, r"[.,!%&$#*]+$", "")
    lead = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    contents = d % 3 == 0
    text = (
        F.when(contents & (i == 0), "TABLE OF CONTENTS")
        .when(contents & i.isin(1, 2, 3), lead("Chapter ", i.cast("string"), ". ", line, " ........ ", (i * 7).cast("string")))
        .when(m == 0, lead("Chapter ", k, ". ", line))
        .when(m == 1, lead(F.substring(line, 1, 10), "\u00a0", F.substr(line, F.lit(11)), " • item; next"))
        .when(m == 2, lead("Sub-chapter ", k, ".1 ", line))
        .when(m == 3, lead("Section ", k, ".2.1 Scope ", bare, ":"))
        .when(m == 4, lead(line, " The firm shall comply, see Article 5 of the 2004 Law. Circular CSSF 18/698"))
        .when(m == 5, lead("Sub-section ", k, ".4 ", line))
        .when(m == 6, lead(line, "\ntail one.\n\ntail two"))
        .when(m == 7, lead(bare, "-"))
        .when(m == 8, F.lower(line))
        .when(m == 9, lead("Part iv ", line))
        .when(m == 10, lead("This means: ", line, " The penalty of Section 12 and point 3 is 5 CFR 2.1."))
        .otherwise(line)
    )
    slot = i % PER_PAGE
    y0 = (slot * 235 + 20 + 25 * (d % 2)).cast("double")
    high = F.when(d % 5 == 0, 90.0).otherwise(40.0)
    bbox = F.array(F.lit(72.0), y0, F.lit(540.0), y0 + high)
    page = (F.floor(i / PER_PAGE) + 1).cast("int")
    return lines.select("doc_id", "block_idx", page.alias("page"), bbox.alias("bbox"), F.lit(792.0).alias("height"), text.alias("text"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the blocks of each document, a line or more each."""
    lines = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.concat_ws("\n", F.transform(lines, lambda s: s["text"])).alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content, headers, page, embedding): all documents, with references added; where there is no embedding, it is null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = documents(spark, sf_dir).join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    n = F.col("doc_id")
    content = F.concat(F.col("text"), F.lit("\nsee Article "), (n % 9).cast("string"), F.lit(" and Section "), (n % 13).cast("string"), F.lit("; CSSF Regulation 12-"), (n % 7).cast("string"))
    headers = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("Section "), (n % 20).cast("string")))
    return rows.select(n.alias("id"), content.alias("content"), headers.alias("headers"), (n % 50 + 1).cast("int").alias("page"), "embedding")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, embedding) made from every chunk whose id is divisible by 20."""
    rows = chunks(spark, sf_dir).where("id % 20 = 0")
    words = F.concat_ws(" ", F.slice(F.split(F.split("content", "\n")[0], " "), 1, 4))
    topic = F.when(F.col("id") % 2 == 0, " requirements of").otherwise(" rule in")
    query = F.concat(F.lit("What is the"), topic, F.lit(" article "), (F.col("id") % 9).cast("string"), F.lit(" with section 12 "), words)
    return rows.select(F.col("id").alias("query_id"), query.alias("query"), "embedding")


def embed_letters(chunks: DataFrame, column: str) -> DataFrame:
    """chunks with an embedding that SQL can make too: how often each letter occurs."""
    c = F.lower(column)
    return chunks.withColumn("embedding", F.array(*((F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("float") for x in LETTERS)))


def scratch(name: str) -> str:
    """A folder for a table that a query writes: in the session's checkpoint folder, which all executors share, or, in one process, a temporary one."""
    spark = SparkSession.active()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, element_idx, page, text): blocks of which two in three don't know their page."""
    page = F.when(F.col("block_idx") % 3 == 0, F.col("page"))
    return blocks(spark, sf_dir).select("doc_id", F.col("block_idx").alias("element_idx"), page.alias("page"), "text")


# The same in DuckDB.

DOCUMENTS_SQL = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_BARE = "regexp_replace(line, '[.,!%&$#*]+$', '')"
BLOCKS_SQL = f"""lines AS (
  SELECT doc_id, unnest(range(len(s)))::INT AS block_idx, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), blocks AS (
  SELECT doc_id, block_idx, (block_idx // {PER_PAGE} + 1)::INT AS page,
    ((block_idx % {PER_PAGE}) * 235 + 20 + 25 * (doc_id % 2))::DOUBLE AS y0,
    ((block_idx % {PER_PAGE}) * 235 + 20 + 25 * (doc_id % 2))::DOUBLE + CASE WHEN doc_id % 5 = 0 THEN 90.0 ELSE 40.0 END AS y1,
    792.0::DOUBLE AS height,
    CASE
      WHEN doc_id % 3 = 0 AND block_idx = 0 THEN 'TABLE OF CONTENTS'
      WHEN doc_id % 3 = 0 AND block_idx IN (1, 2, 3) THEN 'Chapter ' || block_idx || '. ' || line || ' ........ ' || (block_idx * 7)
      WHEN (block_idx + doc_id) % 12 = 0 THEN 'Chapter ' || (block_idx // 3 + 1) || '. ' || line
      WHEN (block_idx + doc_id) % 12 = 1 THEN substr(line, 1, 10) || chr(160) || substr(line, 11) || ' • item; next'
      WHEN (block_idx + doc_id) % 12 = 2 THEN 'Sub-chapter ' || (block_idx // 3 + 1) || '.1 ' || line
      WHEN (block_idx + doc_id) % 12 = 3 THEN 'Section ' || (block_idx // 3 + 1) || '.2.1 Scope ' || {_BARE} || ':'
      WHEN (block_idx + doc_id) % 12 = 4 THEN line || ' The firm shall comply, see Article 5 of the 2004 Law. Circular CSSF 18/698'
      WHEN (block_idx + doc_id) % 12 = 5 THEN 'Sub-section ' || (block_idx // 3 + 1) || '.4 ' || line
      WHEN (block_idx + doc_id) % 12 = 6 THEN line || chr(10) || 'tail one.' || chr(10) || chr(10) || 'tail two'
      WHEN (block_idx + doc_id) % 12 = 7 THEN {_BARE} || '-'
      WHEN (block_idx + doc_id) % 12 = 8 THEN lower(line)
      WHEN (block_idx + doc_id) % 12 = 9 THEN 'Part iv ' || line
      WHEN (block_idx + doc_id) % 12 = 10 THEN 'This means: ' || line || ' The penalty of Section 12 and point 3 is 5 CFR 2.1.'
      ELSE line
    END AS text
  FROM lines
)"""
JOINED_SQL = BLOCKS_SQL + """, joined AS (
  SELECT doc_id, string_agg(text, chr(10) ORDER BY block_idx) AS text FROM blocks GROUP BY doc_id
)"""
CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS id, text || chr(10) || 'see Article ' || (doc_id % 9) || ' and Section ' || (doc_id % 13) || '; CSSF Regulation 12-' || (doc_id % 7) AS content,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Section ' || (doc_id % 20) END AS headers, (doc_id % 50 + 1)::INT AS page, embedding::DOUBLE[] AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL
), queries AS (
  SELECT id AS query_id, 'What is the' || CASE WHEN id % 2 = 0 THEN ' requirements of' ELSE ' rule in' END || ' article ' || (id % 9) || ' with section 12 '
    || array_to_string(string_split(string_split(content, chr(10))[1], ' ')[1:4], ' ') AS query, embedding AS q_embedding
  FROM chunks WHERE id % 20 = 0
)"""
