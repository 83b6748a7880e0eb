"""Document fingerprints by winnowing: rolling k-gram hashes, a minimum per window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import _BASE, buffers, powers, prefix, ragged, slices, sliding_min, table

#: Characters of a k-gram, and k-grams of a window: equal runs of K + WINDOW - 1
#: characters always share a fingerprint, and runs shorter than K never do.
K, WINDOW = 25, 76
#: Bytes of a document that are read at once.
PART = 1 << 22
_SPACES = tuple(b" \t\n\r\f\v")


def _solid(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points that aren't white space, ASCII letters in lower case, and their positions."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    code = np.where((code >= 65) & (code <= 90), code + 32, code)
    solid = np.ones(len(code), bool)
    for s in _SPACES:
        solid &= code != s
    where = np.flatnonzero(solid)
    return code[where], where


def _hashes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-grams, and keys of which the least is a window's choice."""
    sums = prefix(code)
    hashes = (sums[k:] - sums[:-k]) * powers("down", len(code) - k + 1)
    return hashes, (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))


def _chosen(keys: np.ndarray) -> np.ndarray:
    gram = np.sort((np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64))
    return gram[np.concatenate([[True], gram[1:] != gram[:-1]])] if len(gram) else gram


def winnow(data: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position (in characters of the text) and hash of each fingerprint.

    Characters are code points; ASCII white space is skipped and ASCII letters count in
    lower case. A window's lowest upper half of a hash wins, the rightmost of equals. A
    text with k-grams but fewer than a window of them gives its lowest one.
    """
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    code, where = _solid(data)
    edge = np.searchsorted(where, at)
    if len(code) < k:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes, key = _hashes(code, k)
    grams = np.maximum(np.diff(edge) - k + 1, 0)
    low = sliding_min(key, window)
    full = np.flatnonzero(grams >= window)
    inside = grams[full] - window + 1
    starts = np.repeat(edge[full], inside) + ragged(inside)
    some = np.flatnonzero((grams > 0) & (grams < window))
    short = np.array([key[edge[r] : edge[r] + grams[r]].min() for r in some], np.uint64)
    gram = _chosen(np.concatenate([low[starts], short]))
    row = np.searchsorted(edge, gram, "right") - 1
    return row, where[gram] - at[row], hashes[gram]


def winnow_long(data: np.ndarray, k: int, window: int, limit: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of one document's fingerprints, found in parts of about limit bytes; the same as winnow's.

    Of each part the last characters are kept, so that every window lies within a part
    and those before it; what is chosen never lies before what was chosen last.
    """
    code, where = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    seen, last, lo = 0, -1, 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        more, at = _solid(data[lo:hi])
        code, where = np.concatenate([code, more]), np.concatenate([where, at + seen])
        seen += int(((data[lo:hi] & 0xC0) != 0x80).sum())
        lo = hi
        if len(code) - k + 1 >= window:
            hashes, key = _hashes(code, k)
            gram = _chosen(sliding_min(key, window))
            gram = gram[where[gram] > last]
            if len(gram):
                last = int(where[gram[-1]])
                yield where[gram], hashes[gram]
            code, where = code[len(code) - (k + window - 2) :], where[len(where) - (k + window - 2) :]
    if last < 0 and len(code) >= k:
        hashes, key = _hashes(code, k)
        gram = _chosen(key.min()[None])
        yield where[gram], hashes[gram]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, position, fingerprint) of every document's whole text.

    A null text, an empty one and one of fewer than k characters that aren't white space
    have no fingerprints, nor has an empty table. A null doc_id stays null. Repeated rows
    give repeated results. Other columns of docs aren't read. A very long text is read in
    parts, with the same result.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            data, offsets = buffers(texts)
            for a, b in slices(offsets):
                if offsets[b] - offsets[a] > PART:  # one document
                    for position, hashes in winnow_long(data[offsets[a] : offsets[b]], k, window):
                        columns = [ids.take(pa.array(np.full(len(position), a))), pa.array(position, pa.int64()), pa.array((hashes >> np.uint64(1)).astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "fingerprint"])
                    continue
                row, position, hashes = winnow(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k, window)
                columns = [ids.take(pa.array(row + a)), pa.array(position, pa.int64()), pa.array((hashes >> np.uint64(1)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "position", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {kind}, position bigint, fingerprint bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(table(sf_dir, "documents")))


def oracle(k: int = K, window: int = WINDOW) -> str:
    """The same rows in DuckDB: hashes are sums of code points times powers, modulo 2**64, in two halves of 32 bits."""
    powers_ = [pow(_BASE, i, 1 << 64) for i in range(k)]
    leads = "".join(f", lead(code, {i}) OVER grams AS c{i}" for i in range(1, k))
    low = " + ".join(f"c{i} * {p & 0xFFFFFFFF}::BIGINT" for i, p in enumerate(powers_))
    high = " + ".join(f"c{i} * {p >> 32}::BIGINT" for i, p in enumerate(powers_))
    return f"""
WITH chars AS (
  SELECT doc_id, unnest(range(length(text))) AS position, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0
), codes AS (
  SELECT doc_id, position, (CASE WHEN unicode(c) BETWEEN 65 AND 90 THEN unicode(c) + 32 ELSE unicode(c) END)::INTEGER AS code
  FROM chars WHERE c NOT IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13))
), led AS (
  SELECT doc_id, position, code AS c0{leads}, row_number() OVER grams AS g, count(*) OVER (PARTITION BY doc_id) - {k - 1} AS n
  FROM codes WINDOW grams AS (PARTITION BY doc_id ORDER BY position)
), halves AS (
  SELECT doc_id, position, g, n, {low} AS low, {high} AS high FROM led WHERE g <= n
), keyed AS (
  SELECT doc_id, position, g, n, low & 4294967295 AS low, (high + (low >> 32)) & 4294967295 AS high FROM halves
), lows AS (
  SELECT doc_id, g, n, min((high::UBIGINT << 32) + (4294967295 - g)::UBIGINT) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS least FROM keyed
), picked AS (
  SELECT DISTINCT doc_id, 4294967295 - (least & 4294967295)::BIGINT AS g FROM lows WHERE g = 1 OR g <= n - {window} + 1
)
SELECT k.doc_id, k.position::BIGINT AS position, (k.high << 31) + (k.low >> 1) AS fingerprint
FROM picked p JOIN keyed k ON p.doc_id = k.doc_id AND p.g = k.g"""
