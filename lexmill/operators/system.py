"""A retrieval system in one object: documents in, searches and answers with sources out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import embedding_text
from lexmill.operators import retrieval as R
from lexmill.sources import sinks

Embed = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class RetrievalConfig:
    """provider and online name the embedder; backend is memory or index; cache_root keeps embeddings where it is given."""

    provider: str = "local"
    online: bool = False
    backend: str = "memory"
    embedder: str = "hashed"
    top_k: int = 5
    index_name: str = "passages"
    cache_root: str | None = None

    def cache_name(self) -> str:
        """Tells caches of different embedders apart."""
        return "azure_search" if self.backend == "index" else f"{self.provider}_online" if self.online else "local"


PRESETS = {"unified": RetrievalConfig(), "azure": RetrievalConfig("azure", online=True), "openai": RetrievalConfig("openai", online=True), "index": RetrievalConfig(backend="index"), "minimal": RetrievalConfig(top_k=3)}


class RetrievalSystem:
    def __init__(self, spark: SparkSession, config: RetrievalConfig | str = "unified", embed: Embed = R.embed_hashed, generate: Callable[[Column], Column] = R.extractive):
        self.spark = spark
        self.config = PRESETS[config] if isinstance(config, str) else config
        self.embed, self.generate = embed, generate
        self.chunks: DataFrame | None = None

    def add_documents(self, blocks: DataFrame) -> DataFrame:
        """Embed processed blocks or chunks and keep them as the collection. Ids grow with document and block, with gaps."""
        order = [c for c in ("doc_id", "block_idx", "chunk_id") if c in blocks.columns]
        rows = blocks.orderBy(*order).withColumn("id", F.monotonically_increasing_id())
        headers = F.col("enriched_headers") if "enriched_headers" in blocks.columns else F.lit("")
        rows = rows.select("id", embedding_text(headers, F.col("text")).alias("content"), headers.alias("headers"), "page")
        if self.config.cache_root:
            rows = sinks.embed_cached(rows, self.embed, self.config.cache_root, f"{self.config.embedder}_{self.config.cache_name()}")
        else:
            rows = self.embed(rows, "content")
        self.chunks = R.drop_unembedded(rows)
        if self.config.backend == "index":
            sinks.add_to_index(self.chunks, self.config.index_name)
            self.chunks = self.spark.table(self.config.index_name).select(F.col("block_id").alias("id"), "content", "headers", "page", "embedding")
        return self.chunks

    def _asked(self, queries: Iterable[str] | DataFrame) -> DataFrame:
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
        return queries if "embedding" in queries.columns else self.embed(queries, "query")

    def search(self, queries: Iterable[str] | DataFrame, top_k: int | None = None) -> DataFrame:
        """The best chunks for each query; none while no documents have been added."""
        if self.chunks is None:
            return self.spark.createDataFrame([], "query_id bigint, query string, rank int, id bigint, score double, content string, headers string, page int")
        return R.search(self.chunks, self._asked(queries), top_k or self.config.top_k)

    def answer(self, queries: Iterable[str] | DataFrame, top_k: int | None = None) -> DataFrame:
        """Answers with sources, references and confidence; see retrieval.answers."""
        chunks = self.chunks
        if chunks is None:
            chunks = self.spark.createDataFrame([], "id bigint, content string, headers string, page int, embedding array<float>")
        return R.answers(self._asked(queries), chunks, top_k or self.config.top_k, self.generate)

    def stats(self) -> dict[str, int]:
        return {"total_documents": 0 if self.chunks is None else self.chunks.count()}

    def info(self) -> dict[str, object]:
        return asdict(self.config) | {"cache_name": self.config.cache_name()}

    def drop(self) -> None:
        self.chunks = None
        if self.config.backend == "index":
            sinks.drop_index(self.spark, self.config.index_name)
