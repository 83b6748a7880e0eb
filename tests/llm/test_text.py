import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import _text as t


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t", max_size=12)), max_size=8))
def test_words_are_those_of_split(texts):
    data, offsets = t.buffers(pa.array(texts, pa.string()))
    w = t.words(data, offsets)
    raw = bytes(data)
    found = [[raw[w.start[i] : w.end[i]] for i in range(w.row[r], w.row[r + 1])] for r in range(len(texts))]
    assert found == [(x or "").encode().split() for x in texts]
    hashes = {}
    for r in range(len(texts)):
        for i in range(w.row[r], w.row[r + 1]):
            assert hashes.setdefault(raw[w.start[i] : w.end[i]], w.hash[i]) == w.hash[i]
    assert len(set(hashes.values())) == len(hashes)


def test_long_document_in_parts():
    text = " ".join(f"w{i}" for i in range(5000))
    data, offsets = t.buffers(pa.array([text]))
    a, b = t.words(data, offsets), t.words(data, offsets, limit=777)
    assert np.array_equal(a.hash, b.hash) and np.array_equal(a.start, b.start) and np.array_equal(a.end, b.end)


@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 12))
def test_sliding_min(values, width):
    found = t.sliding_min(np.array(values, np.int64), width).tolist()
    assert found == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
