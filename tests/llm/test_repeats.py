import random
from collections import defaultdict

import numpy as np
import pytest

from lexmill.llm import repeats
from tests.conftest import compare


def brute(rows, length):
    seen = defaultdict(list)
    for doc, text in rows:
        w = (text or "").split() if doc is not None else []
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].append((doc, p))
    marks = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            first, *rest = sorted(places)
            marks[first[0], True].add(first[1])
            for doc, p in rest:
                marks[doc, False].add(p)
    out = set()
    for (doc, first), at in marks.items():
        for p in sorted(at):
            if p - 1 not in at:
                end = p
                while end + 1 in at:
                    end += 1
                out.add((doc, p, end + length, end + length - p, first))
    return out


@pytest.mark.parametrize("kinds", [1, 3, repeats.KINDS])
@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, docs, seed, kinds):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    shared = [text(9) for _ in range(3)]
    rows = [(i, " ".join(r.choice([text(r.randint(0, 12)), r.choice(shared)]) for _ in range(r.randint(0, 4)))) for i in range(40)]
    rows += [(100, "x " * 30), (101, None), (None, shared[0]), (102, rows[3][1]), (103, "q " * 6)]
    found = repeats.repeated_passages(docs(rows), length=5, group=2, kinds=kinds).collect()
    assert {tuple(x) for x in found} == brute(rows, 5)
    assert len(found) == len({tuple(x) for x in found})


def test_bounded_prefixes():
    r = np.random.default_rng(1)
    for _ in range(150):
        text = np.append(r.integers(0, r.integers(2, 6), r.integers(2, 90)) + 1, 0)
        depth = int(r.integers(1, 12))
        order = repeats.suffix_array(text, depth)
        found = repeats.bounded_lcp(text, order, depth)
        plain = text.tolist()
        for i in range(1, len(text)):
            a, b = plain[order[i - 1] :], plain[order[i] :]
            k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert found[i] == (k if k < depth else -1)


def test_odd_cases(odd, none):
    rows = {tuple(x) for x in repeats.repeated_passages(odd, length=8, group=3).collect()}
    assert {r[0] for r in rows} == {4, 5, 6}
    assert repeats.repeated_passages(none).count() == 0


def test_same_rows_as_duckdb(spark, tiny):
    left, right = compare(spark, tiny, repeats.query, repeats.oracle())
    assert left == right and left[1]
