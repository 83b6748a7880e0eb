import random

import pytest
import tiktoken

from lexmill.llm import bpe, tokencount
from tests.llm.conftest import LONG


@pytest.fixture(scope="module")
def reference():
    b = bpe.vocabulary()
    return tiktoken.Encoding("reference", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={}).encode_ordinary


def made_up(r):
    parts = ["the ", " ", "  ", "\n\n", "'ll", "'", "l", "é", "ing", "12", "!!", "x" * r.randint(1, 90), "ñ", "\t", "'re ", "日本", "\U0001f600", "<|endoftext|>"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 120)))


def test_equals_reference(reference):
    b, r = bpe.vocabulary(), random.Random(5)
    for _ in range(200):
        text = made_up(r)
        ids, n = b.encode([text])
        assert ids.tolist() == reference(text) and n.tolist() == [len(ids)]
        assert b.decode(ids) == text


def test_query_shape(spark, odd, none, reference):
    rows = bpe.encode(odd).collect()
    named = [(r.text, r["token_ids_"], r["n_tokens_"], r["round_trip"]) for r in rows]
    assert all(r["token_ids"] == "x" for r in rows)
    for text, ids, n, same in named:
        assert (ids, n, same) == ((None, None, None) if text is None else (reference(text), len(reference(text)), True))
    assert bpe.encode(none).count() == 0


def test_decode_column(spark):
    rows = spark.createDataFrame([([464, 3290],), ([],), (None,), ([464, None, 10**6, -5],)], "ids array<int>")
    assert [r.t for r in rows.select(bpe.decoded(rows["ids"]).alias("t")).collect()] == ["The dog", "", None, "The" + "�" * 3]


def test_chunked_counts(reference):
    b, r = bpe.vocabulary(), random.Random(6)
    widened = 0
    for _ in range(300):
        text = made_up(r)
        n, w = tokencount.count_chunked(b, text, chunk=r.randint(5, 60), overlap=r.randint(1, 20))
        widened += w
        assert n == len(reference(text))
    assert widened


def test_counts_of_documents(odd, none, docs, reference):
    rows = tokencount.token_counts(odd, chunk=1000, overlap=50).collect()
    want = [(r.doc_id, None if r.text is None else len(reference(r.text))) for r in odd.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, r.n_tokens) for r in rows], key=str) == sorted(want, key=str)
    assert max(r.n_chunks or 0 for r in rows if r.doc_id == 6) > 100
    assert tokencount.token_counts(none).count() == 0
    huge = [(1, LONG), (1, LONG), (2, "z" * 9000 + LONG[:500])]
    assert sorted((r.doc_id, r.n_tokens) for r in tokencount.token_counts(docs(huge), chunk=2000, overlap=16).collect()) == sorted((i, len(reference(t))) for i, t in huge)
