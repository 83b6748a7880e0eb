import random

import pyarrow as pa
import pytest

from lexmill.llm import fingerprints as fp
from lexmill.llm._text import _BASE, buffers
from tests.conftest import compare


def brute(text, k, window):
    chars = [(i, c.lower() if "A" <= c <= "Z" else c) for i, c in enumerate(text or "") if c not in " \t\n\r\f\v"]
    grams = [(sum(ord(c) * pow(_BASE, j, 1 << 64) for j, (_, c) in enumerate(chars[g : g + k])) % (1 << 64), chars[g][0]) for g in range(len(chars) - k + 1)]
    picked = set()
    for s in range(max(len(grams) - window + 1, 1 if grams else 0)):
        part = range(s, min(s + window, len(grams)))
        low = min(grams[g][0] >> 32 for g in part)
        picked.add(max(g for g in part if grams[g][0] >> 32 == low))
    return {(grams[g][1], grams[g][0] >> 1) for g in picked}


@pytest.mark.parametrize("k, window", [(3, 4), (5, 9), (2, 1), (25, 76)])
def test_equals_brute_force(docs, k, window):
    r = random.Random(k)
    texts = ["".join(r.choice("aB é日\n") for _ in range(r.randint(0, 300))) for _ in range(25)] + ["aaaaaaaaaaaaaaaa", "", None, "ab", " "]
    rows = fp.fingerprints(docs(list(enumerate(texts))), k, window).collect()
    want = {(i, p, h) for i, t in enumerate(texts) for p, h in brute(t, k, window)}
    assert {tuple(x) for x in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("k, window", [(3, 4), (5, 9), (25, 76)])
def test_long_document_in_parts(k, window):
    r = random.Random(window)
    texts = ["".join(r.choice("aB é日\n") for _ in range(n)) for n in (0, 3, 40, 99, 100, 101, 3000)] + [" " * 900 + "abcdefgh" * 4 + " " * 900, "a" * 700]
    for text in texts:
        data, offsets = buffers(pa.array([text]))
        for limit in (1, 50, 333):
            parts = list(fp.winnow_long(data, k, window, limit))
            found = [(int(p), int(h) >> 1) for ps, hs in parts for p, h in zip(ps, hs, strict=True)]
            assert len(found) == len(set(found)) and set(found) == brute(text, k, window)


def test_match_guarantee(docs):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    k, window = 5, 8
    for _ in range(5):
        shared = text(k + window - 1)
        rows = fp.fingerprints(docs([(1, text(40) + shared + text(9)), (2, text(17) + shared + text(30))]), k, window).collect()
        assert {x.fingerprint for x in rows if x.doc_id == 1} & {x.fingerprint for x in rows if x.doc_id == 2}


def test_odd(odd, none):
    rows = fp.fingerprints(odd).collect()
    assert {x.doc_id for x in rows} == {4, 5, 6, 7, None}
    assert sum(x.doc_id == 4 for x in rows) == 2 * sum(x.doc_id == 5 for x in rows)
    assert fp.fingerprints(none).count() == 0


def test_same_rows_as_duckdb(spark, tiny):
    left, right = compare(spark, tiny, fp.query, fp.oracle())
    assert left == right and left[1]
