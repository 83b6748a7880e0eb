"""Language identification: cosine against several centroids of each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import buffers, fresh, slices, table, thinned

#: Hashed features; bytes of the longest n-gram; rows that are counted together.
WIDTH, LONGEST, ROWS = 4096, 3, 256
#: Bytes of a document that are counted at once.
PART = 1 << 20
UNKNOWN = "und"


def _folded() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_FOLD = _folded()


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters in lower case; what isn't a letter is a space."""
    body = _FOLD[data]
    if len(body) > 1:  # capital letters of the two-byte Latin range
        body[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0).astype(np.uint8)
    return body


def _grams(body: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n, the hashed features of the n-grams that begin at each byte, and which of them hold a letter."""
    code = body.astype(np.uint32)
    gram, blank = code.copy(), body == 32
    for n in range(1, LONGEST + 1):
        if n > 1:
            gram = gram[:-1] * np.uint32(257) + code[n - 1 :] if len(gram) > 1 else gram[:0]
            blank = blank[:-1] & (body[n - 1 :] == 32) if len(blank) > 1 else blank[:0]
        yield n, ((gram * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - 12)).astype(np.int64), ~blank


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte n-grams of letters, a row each."""
    rows = len(offsets) - 1
    if rows == 1 and len(data) > PART:
        return _counts_long(data)
    size = np.diff(offsets)
    base = (np.repeat(np.arange(rows), size) * WIDTH).astype(np.int64)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    out = np.zeros(rows * WIDTH)
    for n, at, some in _grams(_letters(data)):
        fits = (left[: len(at)] >= n) & some
        out += np.bincount(base[: len(at)][fits] + at[fits], minlength=rows * WIDTH)
    return out.reshape(rows, WIDTH)


def _counts_long(data: np.ndarray, part: int | None = None) -> np.ndarray:
    """The counts of one document, a part at a time; each part counts the n-grams that begin in it."""
    part = part or PART
    out = np.zeros(WIDTH)
    for lo in range(0, len(data), part):
        a = max(lo - 1, 0)  # a letter may depend on the byte before
        body = _letters(data[a : lo + part + LONGEST - 1])[lo - a :]
        for _, at, some in _grams(body):
            out += np.bincount(at[:part][some[:part]], minlength=WIDTH)
    return out[None]


def _blocks(texts: pa.Array):
    data, offsets = buffers(texts)
    for a, b in slices(offsets, 1 << 19):
        for c in range(a, b, ROWS):
            d = min(c + ROWS, b)
            yield c, d, _counts(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])


@dataclass
class LanguageModel:
    """Centroids by row, the language and least cosine of each, and feature weights."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def best(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest language, its cosine, and whether the text has any letter."""
        n, k = len(texts), len(self.languages)
        lang, cosine, some = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        member = np.zeros((len(self.owner), k), bool)
        member[np.arange(len(self.owner)), self.owner] = True
        for a, b, counts in _blocks(texts):
            near = self.vectors(counts) @ self.centroids.T
            by = np.stack([near[:, member[:, j]].max(1) for j in range(k)], 1)
            lang[a:b] = np.round(by, 9).argmax(1)
            # Matrix products differ in the last bits with the rows beside a row.
            cosine[a:b] = np.round(by.max(1), 9)
            some[a:b] = counts.any(1)
        return lang, cosine, some


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun at rows that are far from those chosen before."""
    centers = [x.mean(0)]
    while len(centers) < k:
        centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
    c = np.stack(centers)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        at = (x @ c.T).argmax(1)
        c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(texts: pa.Array, langs: list[str], *, clusters: int = 4, slack: float = 0.6, quantile: float = 0.01) -> LanguageModel:
    """Weights and centroids from labelled texts.

    A text is rejected whose cosine to its nearest language is below slack times that
    language's quantile of cosines among its own texts here.
    """
    counts = np.zeros((len(texts), WIDTH), np.float32)
    for a, b, c in _blocks(texts):
        counts[a:b] = c
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    names = sorted(set(langs))
    model = LanguageModel(idf, np.zeros((0, WIDTH)), np.zeros(0, np.int64), names, np.zeros(len(names)))
    x = model.vectors(counts)
    y = np.array([names.index(v) for v in langs])
    parts = [_cluster(x[y == j], min(clusters, int((y == j).sum()))) for j in range(len(names))]
    model.centroids, model.owner = np.concatenate(parts), np.repeat(np.arange(len(names)), [len(p) for p in parts])
    model.least = np.array([slack * np.quantile((x[y == j] @ p.T).max(1), quantile) for j, p in enumerate(parts)])
    return model


def train(spark: SparkSession, sf_dir: str, *, bound: int = 3000, **settings: float) -> LanguageModel:
    """Fit on at most bound rows with a text and a lang, those of the least hashes of doc_id and text.

    Rows are thinned by their hashes before they are sorted, to about twice the bound, so
    that what is gathered has a bound at any size, also where one row repeats.
    """
    docs = spark.read.parquet(table(sf_dir, "documents")).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    some = thinned(docs, docs.count(), bound, F.xxhash64("doc_id", "text"))
    rows = some.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "lang").limit(bound).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    if not len(rows):
        return LanguageModel(np.ones(WIDTH), np.zeros((1, WIDTH)), np.zeros(1, np.int64), [UNKNOWN], np.ones(1))
    return fit(rows["text"].combine_chunks(), rows["lang"].to_pylist(), **settings)


def language(text: Column, model: LanguageModel) -> Column:
    """struct<language, cosine>: und and null for a text without letters or null, und below the least cosine."""

    @F.arrow_udf("struct<language:string,cosine:double>")
    def run(texts: pa.Array) -> pa.Array:
        at, cosine, some = model.best(texts)
        names = np.array([*model.languages, UNKNOWN], object)
        at = np.where(some & (cosine >= model.least[at]), at, len(model.languages))
        return pa.StructArray.from_arrays([pa.array(names[at], pa.string()), pa.array(cosine, mask=~some)], ["language", "cosine"])

    return run.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with language and cosine (with underscores where docs has such names).

    Whole texts are read, however long. A null text, an empty one and one without letters
    get und and a null cosine; equal texts get equal answers, and of languages with equal
    cosines (to nine places) the first by name; an empty table stays empty.
    """
    tmp = fresh(docs, "found")
    out = docs.withColumn(tmp, language(F.col(text), model))
    for name in ("language", "cosine"):
        out = out.withColumn(fresh(docs, name), F.col(f"{tmp}.{name}"))
    return out.drop(tmp)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents")).select("doc_id", "text")
    return identify(docs, train(spark, sf_dir)).drop("text")
