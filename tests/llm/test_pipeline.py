import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from lexmill.llm import bpe, pii, quality
from tests.llm.test_decontaminate import brute
from tests.llm.test_neardup import brute as near


def test_equals_plain_version(spark, tiny):
    """The pipeline's rows by loops over all documents and all pairs, on the smallest table."""
    docs = pq.read_table(f"{tiny}/documents.parquet")
    ids, texts = docs["doc_id"].to_pylist(), docs["text"].to_pylist()
    model = quality.train(spark, tiny)
    good = model.scores(docs["text"].combine_chunks()) >= model.threshold
    left = {i: t for i, t, g in zip(ids, texts, good, strict=True) if g and re.search(r"[^\W_]", t)}
    left = {i: left[i] for i, group, _, _ in near(sorted(left.items())) if i == group}
    bench = pq.read_table(f"{tiny}/benchmark.parquet")
    # Comparing every window with every item is slow: items that share no three words in a row with a text can't reach the similarity.
    items = list(zip(bench["item_id"].to_pylist(), bench["text"].to_pylist(), strict=True))
    spoilt = set()
    runs = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.lower().replace(",", "").replace(".", "").split() for _, t in items)]
    for i, t in left.items():
        w = t.lower().replace(",", "").replace(".", "").split()
        mine = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if any(mine & r for r in runs) and brute([(i, t)], items):
            spoilt.add(i)
    left = {i: t for i, t in left.items() if i not in spoilt}
    trees = pii.load()
    b = bpe.vocabulary()
    want = {}
    for i, t in left.items():
        text = pii._redacted(pa.array([t]), trees).field("text")[0].as_py()
        want[i] = b.encode([text])[0].tolist()
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, tiny).collect()}
    assert set(found) == set(want)
    assert all(found[i].token_ids == want[i] and found[i].round_trip and found[i].n_tokens == len(want[i]) for i in want)
    assert 0 < len(want) < len(ids)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none, tiny):
    for docs in (odd, none):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, tiny)
            assert rows.columns == docs.columns
            rows.count()
        assert set(corpus_pipeline.STAGES[-1][1](spark, rows, tiny).columns) == {"doc_id", "token_ids", "n_tokens", "round_trip"}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, tiny).count()


def test_length_follows_redaction(spark, docs, tiny):
    text = "write to an.b@mail7.example.com now"
    out = corpus_pipeline.redact_personal_data(spark, docs([(1, text), (2, "plain")]), tiny).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in out] == [("write to [EMAIL] now", 20), ("plain", 5)]
    assert np.all([r["pii_spans"] == "x" for r in out])
