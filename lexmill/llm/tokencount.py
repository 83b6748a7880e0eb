"""Exact token counts; huge documents are encoded in overlapping chunks that are spliced.

The words of byte-level BPE are found from left to right, and where the next one begins
depends on nothing before it. So once the scan of a chunk that began anywhere has a word
boundary that is a boundary of the whole text too, the two agree from there on. A chunk
that begins at such a boundary proves all its boundaries but those near its end, which a
few characters beyond could move. Neighbouring chunks are joined at the first boundary
that the left one proves and the right one has. Where an overlap holds none, as within a
very long word, the left chunk is encoded again with twice the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import list_array, table
from lexmill.llm.bpe import VOCABULARY, Bpe, vocabulary

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1 << 15, 256
#: Characters at the end of a cut chunk whose boundaries aren't proven: the pattern looks this far ahead at most.
UNPROVEN = 4
#: Characters of texts whose new words are encoded together.
TOGETHER = 1 << 20


def pieces(bpe: Bpe, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where the words of each text begin, and how many tokens each word has."""
    found, numbers = bpe.words(texts)
    size = [np.fromiter(map(len, words), np.int64, len(words)) for words in found]
    return [(np.cumsum(n) - n, bpe.lengths[at]) for n, at in zip(size, numbers, strict=True)]


def counts_of(bpe: Bpe, texts: list[str | None]) -> list[int | None]:
    """Tokens of each text; null for null. Texts are encoded some TOGETHER characters at a time."""
    out: list[int | None] = [None] * len(texts)
    held, size = [], 0
    for i, t in enumerate([*texts, None]):
        if t is not None:
            held.append(i)
            size += len(t)
        if held and (size >= TOGETHER or i == len(texts)):
            for k, at in zip(held, bpe.words([texts[k] for k in held])[1], strict=True):
                out[k] = int(bpe.lengths[at].sum())
            held, size = [], 0
    return out


def splice(bpe: Bpe, text: str, chunks: list[tuple[int, int, np.ndarray, np.ndarray]], overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a text from its encoded chunks (begin, end, starts, counts), and how often an overlap was widened."""
    total, true, widened, k = 0, 0, 0, 0
    _, end, starts, counts = chunks[0]
    reach = overlap
    while end < len(text):
        begin, right_end, right, right_counts = chunks[k + 1]
        proven = starts[(starts >= true) & (starts <= end - UNPROVEN)]
        common = np.intersect1d(proven, right, assume_unique=True)
        if len(common):
            cut = int(common[0])
            total += int(counts[(starts >= true) & (starts < cut)].sum())
            true, end, starts, counts, reach = cut, right_end, right, right_counts, overlap
            k += 1
            continue
        widened += 1
        reach *= 2
        end = min(len(text), begin + reach)
        starts, counts = pieces(bpe, [text[true:end]])[0]
        starts = starts + true
        while k + 1 < len(chunks) - 1 and chunks[k + 1][1] <= end:
            k += 1
            reach = max(overlap, end - chunks[k + 1][0])
    return total + int(counts[starts >= true].sum()), widened


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of the chunks of a text."""
    out = [(a, min(a + chunk + overlap, length)) for a in range(0, max(length, 1), chunk)]
    while len(out) > 1 and out[-2][1] == length:
        out.pop()
    return out


def count_chunked(bpe: Bpe, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of one text by way of chunks; see splice."""
    at = cuts(len(text), chunk, overlap)
    parts = [(a, b, starts + a, counts) for (a, b), (starts, counts) in zip(at, pieces(bpe, [text[a:b] for a, b in at]), strict=True)]
    return splice(bpe, text, parts, overlap)


def token_counts(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_chunks) of every row of docs.

    The count is that of the whole text in one piece. Texts of more than chunk characters
    are cut, and their chunks are encoded apart from each other. A null text has null
    counts, the empty one 0 tokens in 1 chunk. A null doc_id stays null; repeated rows
    have a row each; an empty table gives none. Other columns aren't read.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    @F.arrow_udf("int")
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array(counts_of(vocabulary(path), texts.to_pylist()), pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "begin", "body"]
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(2)[i].as_py()
                at = cuts(len(body), chunk, overlap)
                n = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(n), batch.column(1).take(n), pa.array([a for a, _ in at], pa.int64()), pa.array([body[a:b] for a, b in at], pa.string())], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            found = pieces(bpe, batch.column("body").to_pylist())
            n = np.array([len(s) for s, _ in found])
            lists = [list_array(pa.array(np.concatenate([f[j] for f in found]).astype(np.int32)), n) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "starts", "counts"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("begin")
        begin = group["begin"].to_pylist()
        bodies = group["body"].to_pylist()
        after = [*begin[1:], begin[-1] + len(bodies[-1])]
        body = "".join(b[: e - a] for a, e, b in zip(begin, after, bodies, strict=True))
        lists = group["starts"].combine_chunks()
        starts, counts = (np.asarray(group[k].combine_chunks().flatten(), np.int64) for k in ("starts", "counts"))
        edge = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        parts = [(a, a + len(b), starts[i:j] + a, counts[i:j]) for a, b, i, j in zip(begin, bodies, edge[:-1], edge[1:], strict=True)]
        total, _ = splice(vocabulary(path), body, parts, overlap)
        return pa.table({"doc_id": group["doc_id"][:1], "n_tokens": pa.array([total], pa.int32()), "n_chunks": pa.array([len(parts)], pa.int32())})

    size = F.char_length("text")
    small = source.where(F.col("text").isNull() | (size <= chunk))
    small = small.select("doc_id", whole.asNondeterministic()("text").alias("n_tokens"), F.when(F.col("text").isNotNull(), 1).alias("n_chunks"))
    huge = source.where(size > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    chunks = huge.mapInArrow(cut, f"doc_id {kind}, row bigint, begin bigint, body string").repartition("row", "begin")
    encoded = chunks.mapInArrow(encode, f"doc_id {kind}, row bigint, begin bigint, body string, starts array<int>, counts array<int>")
    return small.unionByName(encoded.groupBy("row").applyInArrow(join, f"doc_id {kind}, n_tokens int, n_chunks int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(table(sf_dir, "documents")))
