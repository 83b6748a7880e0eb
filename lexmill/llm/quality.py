"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import LOOSE, Words, buffers, fresh, slices, table, thinned, words

_STOP = (
    "the of and to in is that for it was on as with by at an be this from are or which he not "
    "de la que el en y los se las un por con una su para es al lo como más del no "
    "le les des et est une du dans qui pour pas sur au par ce il sont ne plus avec elle "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es"
).split()
_CLASSES = ("lower", "upper", "digit", "space", "newline", "comma", "stop", "pipe", "bang", "symbol", "bracket", "quote", "other", "high")
FEATURES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "short_words", "distinct", "adjacent_repeat",
    "top_word", "stop_words", "words_per_line", "bytes_per_word", "capital_words", "lines_log",
)


def _class_of_byte() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.uint8)
    sets = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r", "newline": b"\n", "comma": b",;:", "stop": b".", "pipe": b"|", "bang": b"!?", "symbol": b"#$%&*@^~+=_\\/", "bracket": b"()[]{}<>", "quote": b"\"'-`", "high": range(128, 256)}
    for name, members in sets.items():
        out[list(members)] = _CLASSES.index(name)
    return out


_CLASS = _class_of_byte()


def _stop_hashes() -> np.ndarray:
    texts = pa.array([" ".join(_STOP)])
    return np.unique(Words(*buffers(texts), LOOSE).hash)


#: Bytes of a document that are counted at once.
_PART = 1 << 22


def _features(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets)
    k = len(_CLASSES)
    if rows == 1:  # perhaps a very long one
        counts = sum((np.bincount(_CLASS[data[a : a + _PART]], minlength=k) for a in range(0, len(data), _PART)), np.zeros(k, np.int64))[None].astype(np.float64)
    else:
        counts = np.bincount(np.repeat(np.arange(rows), size) * k + _CLASS[data], minlength=rows * k).reshape(rows, k).astype(np.float64)
    w = words(data, offsets, LOOSE)
    n = np.diff(w.row)
    row = w.rows()
    per = lambda x: np.bincount(row, weights=x, minlength=rows)
    length = (w.end - w.start).astype(np.float64)
    some, any_words = np.maximum(size, 1), np.maximum(n, 1)
    mean = per(length) / any_words
    key = w.hash ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(ranked)))
    run_row = row[order[starts]] if len(starts) else np.zeros(0, np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, run_row, runs)
    distinct = np.bincount(run_row, minlength=rows)
    same = np.zeros(len(key))
    same[1:] = key[1:] == key[:-1]
    at = np.minimum(np.searchsorted(stops, w.hash), len(stops) - 1)
    capital = (data[w.start] >= 65) & (data[w.start] <= 90)
    lines = counts[:, _CLASSES.index("newline")] + 1
    columns = [
        *(counts[:, i] / some for i in range(k)),
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(per(length**2) / any_words - mean**2, 0)),
        per(length > 12) / any_words, per(length < 3) / any_words, distinct / any_words, per(same) / any_words,
        top / any_words, per(stops[at] == w.hash) / any_words, n / lines, size / any_words, per(capital) / any_words, np.log1p(lines),
    ]
    return np.stack(columns, axis=1)


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of whole texts, a row each; null counts as empty."""
    data, offsets = buffers(texts)
    stops = _stop_hashes()
    parts = [_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stops) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Forest:
    """Complete binary trees of one depth, flattened: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # a value beyond this goes right
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of x, all rows going down a tree together."""
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        every = np.arange(len(x))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[every, feature[node]] > above[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Second-order boosting of the logistic loss on histograms of at most bins quantile bins.

    A node whose best gain isn't positive, or whose children would hold a curvature below
    least, sends all its rows left.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            local = node - first
            gain_best = np.full(count, 1e-9)
            for j in range(width):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(1)
                hs = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                at = gain.argmax(1)
                best = gain[np.arange(count), at]
                for i in np.flatnonzero(best > gain_best):
                    gain_best[i] = best[i]
                    out.feature[t, first + i], out.above[t, first + i] = j, cuts[j][at[i]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.above[t, node])
        last = node - inner
        weight = -np.bincount(last, g, leaves) / (np.bincount(last, h, leaves) + ridge)
        out.leaf[t] = rate * weight
        total += out.leaf[t, last]
    return out


@dataclass
class QualityModel:
    forest: Forest
    threshold: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.forest.score(features(texts))


def sample_labels(spark: SparkSession, sf_dir: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of at most bound labelled documents, picked by a hash of doc_id.

    Of labels with one doc_id the least counts, and so do the least features of documents
    with one doc_id.
    """
    labels = spark.read.parquet(table(sf_dir, "labels")).select("doc_id", F.col("quality").cast("double").alias("y")).dropna()
    some = thinned(labels, labels.count(), bound, F.xxhash64("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    docs = spark.read.parquet(table(sf_dir, "documents")).select("doc_id", "text").where(F.col("text").isNotNull())

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))

    # The sample is bounded by a parameter, so broadcasting it is safe at any size.
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "y", measured("text").alias("x"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.array(rows["x"].combine_chunks().flatten() if len(rows) else [], float).reshape(-1, len(FEATURES))
    return x, np.array(rows["y"], float)


def train(spark: SparkSession, sf_dir: str, *, bound: int = 20_000, held_out: float = 0.2, false_reject: float = 0.002) -> QualityModel:
    """Fit on a sample of at most bound labelled documents.

    The last held_out of it isn't fitted; the threshold is the score below which at most
    false_reject of its good documents lie, 0.5 at most. Without labels of both kinds the
    model keeps everything.
    """
    x, y = sample_labels(spark, sf_dir, bound)
    if len(y) < 20 or y.min() == y.max():
        return QualityModel(Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 5.0), 0.5)
    order = np.random.default_rng(7).permutation(len(y))
    cut = int(len(y) * (1 - held_out))
    fitted, held = order[:cut], order[cut:]
    forest = fit_forest(x[fitted], y[fitted])
    good = np.sort(forest.score(x[held][y[held] == 1]))
    threshold = float(good[int(len(good) * false_reject)]) - 1e-9 if len(good) else 0.5
    return QualityModel(forest, min(threshold, 0.5))


def quality_score(text: Column, model: QualityModel) -> Column:
    """Probability that a text is good; null for null and for a text without words."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = features(texts)
        found = model.forest.score(x)
        return pa.array(found, pa.float64(), mask=x[:, FEATURES.index("log_words")] == 0)

    return score.asNondeterministic()(text)


def classify(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with quality_score and keep (names get underscores where docs has them).

    A null text, or one without words, has a null score and isn't kept. Repeated rows get
    the same score. Whole texts are scored, however long. An empty table stays empty.
    """
    score, keep = fresh(docs, "quality_score"), fresh(docs, "keep")
    scored = docs.withColumn(score, quality_score(F.col(text), model))
    return scored.withColumn(keep, F.coalesce(F.col(score) >= model.threshold, F.lit(False)))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of docs that classify keeps, with docs' columns."""
    score = fresh(docs, "quality_score")
    return docs.withColumn(score, quality_score(F.col(text), model)).where(F.col(score) >= model.threshold).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents")).select("doc_id", "text")
    return classify(docs, train(spark, sf_dir)).select("doc_id", "quality_score", "keep")
