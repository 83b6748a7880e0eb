import numpy as np
import pytest

from lexmill.operators import models, vector_index
from lexmill.operators import retrieval as R
from lexmill.plans import fixture as fx

CHUNKS = "id bigint, content string, headers string, page int, embedding array<double>"


def load_encoder():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return np.array([[len(t), 1.0] for t in texts])

    return encode


def load_talker():
    def answer(messages):
        if "bad" in messages[1]["content"]:
            raise RuntimeError("no tokens left")
        return f" {messages[0]['role']}: {len(messages)} "

    return answer


def test_embedder(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "bad one"), (3, None), (4, "")], "id int, content string")
    out = {r.id: r.embedding for r in models.embedder("lengths", load_encoder, batch=2)(rows, "content").collect()}
    assert out == {1: [3.0, 1.0], 2: [], 3: None, 4: [0.0, 1.0]}
    left = R.drop_unembedded(models.embedder("lengths", load_encoder)(rows, "content")).select("id").collect()
    assert sorted(r.id for r in left) == [1, 4]


def test_generator(spark):
    chunks = spark.createDataFrame([(0, "good text", "", 1, [1.0, 0.0]), (1, "bad text", "", 1, [0.0, 1.0])], CHUNKS)
    asked = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "query_id int, query string, embedding array<double>")
    out = {r.query_id: r.answer for r in R.answers(asked, chunks, 1, models.generator("talker", load_talker)).collect()}
    assert out == {1: "system: 2", 2: "Error generating response with talker: no tokens left"}


def test_index_recall(spark, tmp_path):
    """Every twentieth row against all, held against the exact search; all probes are exact."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    chunks = rows.select(rows["vec_id"].alias("id"), "embedding")
    asked = rows.where("vec_id % 20 = 0").select(rows["vec_id"].alias("query_id"), "embedding")
    vector_index.build(chunks, f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i/lists").count() == chunks.count()
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = R.top_cosine_batch(chunks, asked, 10)
    want = pairs(exact)
    assert len(pairs(vector_index.search(spark, f"{tmp_path}/i", asked, 10)) & want) / len(want) >= 0.9
    every = vector_index.search(spark, f"{tmp_path}/i", asked, 10, probes=10_000)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert vector_index.search(spark, f"{tmp_path}/i", asked.where("query_id < 0")).count() == 0


def test_index_of_few_and_odd_rows(spark, tmp_path):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0])], "id int, embedding array<double>")
    vector_index.build(chunks, f"{tmp_path}/i", lists=9)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id int, embedding array<double>")
    assert [(r.query_id, r.id, r.score) for r in vector_index.search(spark, f"{tmp_path}/i", asked, 2).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 1, 1.0)]
    with pytest.raises(ValueError):
        vector_index.build(chunks.where("id = 2"), f"{tmp_path}/j")


def test_clusters_within_documents(spark):
    r = np.random.default_rng(0)
    rows = [(d, i, (np.eye(3)[i % 3] * 10 + r.normal(size=3) * 0.1).tolist()) for d, n in ((1, 12), (2, 5)) for i in range(n)] + [(1, 99, None)]
    out = {(x.doc_id, x.chunk_idx): x.semantic_cluster for x in R.cluster_documents(spark.createDataFrame(rows, "doc_id int, chunk_idx int, embedding array<double>")).collect()}
    groups = [{out[1, i] for i in range(12) if i % 3 == k} for k in range(3)]
    assert not (groups[0] & groups[1] or groups[0] & groups[2] or groups[1] & groups[2]) and len(set.union(*groups)) == 4
    assert out[1, 0] == 0 and out[1, 99] is None and all(out[2, i] is None for i in range(5))


def test_letters(spark):
    row = fx.embed_letters(spark.createDataFrame([("aAb",)], "t string"), "t").first()
    assert row.embedding[:3] == [2.0, 1.0, 0.0] and len(row.embedding) == 26
