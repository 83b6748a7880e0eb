"""Quality and language: held-out accuracy, and odd cases."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lexmill.llm import language, quality


def test_flat_trees_equal_walks():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality.fit_forest(x[:300], y[:300], trees=30, depth=3)
    score = forest.score(x)
    for row, s in zip(x[:50], score, strict=False):
        total = forest.base
        for f, a, leaf in zip(forest.feature, forest.above, forest.leaf, strict=True):
            node = 0
            while node < f.size:
                node = 2 * node + 1 + int(row[f[node]] > a[node])
            total += leaf[node - f.size]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9
    assert ((score[300:] > 0.5) == y[300:]).mean() > 0.85


def test_quality_held_out(spark):
    """Fitted on one half of the labelled documents, judged on the other."""
    x, y = quality.sample_labels(spark, "/root/testdata/sf0.1", 20_000)
    order = np.random.default_rng(5).permutation(len(y))
    a, b = order[: len(y) // 2], order[len(y) // 2 :]
    score = quality.fit_forest(x[a], y[a]).score(x[b])
    assert (score[y[b] == 1] > 0.5).mean() > 0.98
    assert (score[y[b] == 0] > 0.5).mean() < 0.1


def test_quality_odd(spark, odd, none, tiny):
    model = quality.train(spark, tiny)
    rows = quality.classify(odd, model).collect()
    assert all(r["keep"] == "x" for r in rows)
    for r in rows:
        if r.doc_id in (1, 2, 3, 8) or r.text is None:
            assert r["quality_score_"] is None and r["keep_"] is False
        else:
            assert 0 <= r["quality_score_"] <= 1
    assert len({r["quality_score_"] for r in rows if r.doc_id in (4, 5)}) == 1
    assert quality.keep_good(odd, model).columns == odd.columns
    assert quality.classify(none, model).count() == 0


def test_no_labels_keeps_all(spark, docs, tmp_path):
    docs([(1, "some text here")]).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.keep for r in quality.query(spark, str(tmp_path)).collect()] == [True]


def test_language_held_out(spark):
    model = language.train(spark, "/root/testdata/sf0.01")
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet").slice(5000, 2000)
    texts, want = table["text"].combine_chunks(), table["lang"].to_pylist()
    at, cosine, some = model.best(texts)
    kept = some & (cosine >= model.least[at])
    right = np.array([model.languages[i] == w for i, w in zip(at, want, strict=True)])
    assert right.mean() > 0.98
    assert kept.mean() > 0.98
    strange = pa.array(["пример текста на другом языке", "これは日本語の文章です", "zqx jvk wqz xkq vjz qqx zzk"])
    at, cosine, some = model.best(strange)
    assert not (some & (cosine >= model.least[at])).any()


def test_nearest_centroid_by_hand(spark, tiny):
    model = language.train(spark, tiny, bound=100)
    assert len(model.centroids) > len(model.languages)
    texts = pa.array(["the and of that", "und der die das", "la de los que"])
    at, cosine, _ = model.best(texts)
    for i, t in enumerate(texts.to_pylist()):
        data = np.frombuffer(t.encode(), np.uint8)
        v = model.vectors(language._counts(data, np.array([0, len(data)])))[0]
        near = [max(float(v @ c) for c, o in zip(model.centroids, model.owner, strict=True) if o == j) for j in range(len(model.languages))]
        assert at[i] == int(np.argmax(near)) and abs(cosine[i] - max(near)) < 1e-8


def test_language_odd(spark, odd, none, tiny):
    model = language.train(spark, tiny)
    rows = language.identify(odd, model).collect()
    for r in rows:
        assert r["language"] == "x" and r["cosine"] == "x"
        if r.text is None or r.doc_id in (2, 3, 8):
            assert (r["language_"], r["cosine_"]) == ("und", None)
    assert len({(r["language_"], r["cosine_"]) for r in rows if r.doc_id in (4, 5)}) == 1
    assert language.identify(none, model).count() == 0
