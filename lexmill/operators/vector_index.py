"""An index of vectors for approximate search: inverted lists around centroids.

Centroids are fitted on a bounded sample, and every row goes to the list of its nearest
one. A search looks into the lists nearest to each query only, as many as give the wanted
recall within the sample; lists are folders, so that no other is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.operators.retrieval import BATCH, _rank

#: Rows on which centroids are fitted, and lists at most.
SAMPLE, LISTS = 20_000, 4096
#: Rows of the sample that are asked for their NEIGHBOURS nearest ones in it, and the recall that lists must give.
ASKED, NEIGHBOURS, RECALL = 256, 10, 0.93


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, seed: int = 42, rounds: int = 25, spherical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the nearest one of each row; begun by chance, far rows being likelier."""
    r = np.random.default_rng(seed)
    centers = x[[int(r.integers(len(x)))]]
    near = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), r.random() * total)) if total > 0 else int(r.integers(len(x)))
        centers = np.vstack([centers, x[min(at, len(x) - 1)]])
        near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        now = (x @ centers.T * 2 - (centers**2).sum(1)).argmax(1)
        sums, count = np.zeros_like(centers), np.bincount(now, minlength=k)
        np.add.at(sums, now, x)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        centers = _unit(centers) if spherical else centers
        if np.array_equal(now, own):
            break
        own = now
    return centers, own


def fit(chunks: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 42, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centroids of about the square root of the rows' number, LISTS at most, fitted on sample rows at most, and the lists to look into for the recall.

    Rows are thinned by a hash of their ids to about twice the sample before they are sorted by it.
    """
    rows = chunks.where(F.size("embedding") > 0).select("id", "embedding")
    n = rows.count()
    if not n:
        raise ValueError("there is no embedding to index")
    h = F.xxhash64("id")
    share = min(1.0, 2 * sample / n)
    some = rows.where(F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else rows
    x = some.orderBy(h, "id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    x = _unit(np.asarray(x.flatten(), np.float64).reshape(len(x), -1))
    k = min(lists or max(1, math.isqrt(n)), LISTS, len(x))
    centers = k_means(x, k, seed, spherical=True)[0]
    own = (x @ centers.T).argmax(1)
    place = (-(x[:ASKED] @ centers.T)).argsort(1, kind="stable").argsort(1)  # of each list, for each row that asks
    near = (-(x[:ASKED] @ x.T)).argsort(1, kind="stable")[:, :NEIGHBOURS]
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return centers, int(needed[min(math.ceil(recall * len(needed)), len(needed)) - 1]) + 1


def build(chunks: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> None:
    """Write the index of all chunks (id, embedding) that have an embedding; an index there already is replaced."""
    centers, probes = fit(chunks, lists, sample, recall=recall)
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(centers)

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = _unit(np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1))
        return pa.array((x @ sent.value.T).argmax(1), pa.int32())

    rows = chunks.where(F.size("embedding") == centers.shape[1]).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.withColumn("list_id", nearest("embedding")).hint("rebalance", "list_id")
    rows.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centers)], "list_id int, center array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, score) of k near chunks for each query, from the probes nearest lists; ties by id.

    Without probes, as many lists as build found necessary; as many probes as there are
    lists make the search exact. Queries without an embedding
    find nothing; they go to the executors BATCH at a time.
    """
    table = spark.read.parquet(f"{path}/centers").orderBy("list_id").toArrow()
    centers = np.stack(table["center"].to_numpy(zero_copy_only=False)).astype(np.float64)
    probes = probes or table["probes"][0].as_py()
    rows = spark.read.parquet(f"{path}/lists")
    key, own = queries.schema["query_id"].dataType, rows.schema["id"].dataType.simpleString()
    out, block = None, []

    def found(block: list) -> DataFrame:
        q = _unit(np.array([r["embedding"] for r in block], np.float64))
        n = min(probes, len(centers))
        near = np.argpartition(-(q @ centers.T), n - 1, axis=1)[:, :n]
        asking = {int(i): np.flatnonzero((near == i).any(1)) for i in np.unique(near)}
        sent = spark.sparkContext.broadcast((pa.array([r["query_id"] for r in block], to_arrow_type(key)), q, asking))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asking = sent.value
            for batch in batches:
                lists = np.asarray(batch.column(2))
                for i in np.unique(lists):
                    mine = np.flatnonzero(lists == i)
                    part = batch.take(pa.array(mine))
                    x = _unit(np.asarray(part.column(1).flatten(), np.float64).reshape(len(mine), -1))
                    who = asking[int(i)]
                    score = np.round(q[who] @ x.T, 6)
                    some = min(k, len(mine))
                    least = np.partition(score, len(mine) - some, axis=1)[:, len(mine) - some]
                    a, b = np.nonzero(score >= least[:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[a])), part.column(0).take(pa.array(b)), pa.array(score[a, b])], ["query_id", "id", "score"])

        wanted = rows.where(F.col("list_id").isin(list(asking))) if len(asking) < len(centers) else rows
        return wanted.select("id", "embedding", "list_id").mapInArrow(run, f"query_id {key.simpleString()}, id {own}, score double")

    for row in queries.where(F.size("embedding") == centers.shape[1]).select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        block.append(row)
        if len(block) == BATCH:
            out, block = found(block) if out is None else out.unionByName(found(block)), []
    if block:
        out = found(block) if out is None else out.unionByName(found(block))
    if out is None:
        return spark.createDataFrame([], f"query_id {key.simpleString()}, rank int, id {own}, score double")
    return _rank(out, k).select("query_id", "rank", "id", "score")
