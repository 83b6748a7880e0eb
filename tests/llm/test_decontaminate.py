import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lexmill.llm import decontaminate as dc
from lexmill.llm._text import LOOSE, buffers, mix, words
from tests.conftest import compare


def hashed(text):
    return words(*buffers(pa.array([text])), LOOSE).hash.tolist()


def fingerprint(hashes):
    """128 bits, each the sign of a sum over words."""
    sums = np.zeros(128, int)
    for h in hashes:
        for half in (0, 1):
            bits = int(mix(np.array([h ^ (half + 1)], np.uint64))[0])
            sums[64 * half : 64 * half + 64] += [1 if bits >> i & 1 else -1 for i in range(64)]
    return sum(1 << i for i, x in enumerate(sums.tolist()) if x > 0)


def brute(rows, items, least=dc.SIMILARITY, radius=dc.RADIUS):
    """The best window of each document and item by comparing all of them, weights, fingerprints and similarities made here."""
    known = {i: hashed(t) for i, t in items if i is not None and t}
    known = {i: h for i, h in known.items() if len(h) >= dc.LEAST_WORDS}
    pairs = {i: list(zip(h, h[1:], strict=False)) for i, h in known.items()}
    seen = Counter(p for ps in pairs.values() for p in set(ps))
    weight = lambda p: round(1000 * math.log1p(len(known) / seen[p])) if p in seen else round(1000 * math.log1p(len(known)))
    prints = {i: fingerprint(h) for i, h in known.items()}
    out = {}
    for doc, text in rows:
        h = hashed(text)
        own = list(zip(h, h[1:], strict=False))
        for i, item in known.items():
            size, whole = len(item), Counter(pairs[i])
            total = sum(weight(p) * n for p, n in whole.items())
            for s in range(len(h)):
                inside = Counter(own[s : s + min(size, len(h) - s) - 1])
                both = sum(weight(p) * min(n, inside[p]) for p, n in whole.items())
                if not both:
                    continue
                score = both / (total + sum(weight(p) * n for p, n in inside.items()) - both)
                if score >= least and score > out.get((doc, i), (0,))[0] and (fingerprint(h[s : s + size]) ^ prints[i]).bit_count() <= radius:
                    out[doc, i] = (score, s, min(size, len(h) - s))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(r.randint(8, 40)))) for i in range(25)]
    rows = []
    for d in range(60):
        body = text(r.randint(0, 80))
        if d % 2:
            w = items[d % 25][1].split()
            for _ in range(d % 4):
                w[r.randrange(len(w))] = word()
            body[len(body) // 2 : len(body) // 2] = w
        rows.append((d, " ".join(body)))
    return rows, items


def test_equals_brute_force(spark, docs):
    rows, items = corpus(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(rows, items)
    found = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in dc.contaminated(docs(rows), bench).collect()}
    assert set(found) == set(want)
    assert all(abs(found[k][0] - want[k][0]) < 1e-12 and found[k][1:] == want[k][1:] for k in want)
    left = {r.doc_id for r in dc.decontaminate(docs(rows), bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in found}
    # What similarity alone would find, whatever the fingerprints.
    every = brute(rows, items, radius=128)
    assert len(found) >= 0.9 * len(every)
    assert np.mean([k in found for k, v in every.items() if v[0] > 0.75]) > 0.97


def test_same_rows_as_duckdb(spark, tiny):
    left, right = compare(spark, tiny, dc.query, dc.oracle())
    assert left == right and left[1]


def test_passes_do_not_change_results(spark, docs):
    """Altered passages near the least similarity, and items that share word pairs with items of other passes."""
    rows, items = corpus(2)
    common = "kept under the rules of the board"
    items = [(i, f"{common} {t}" if i % 3 else t) for i, t in items]
    rows = [*rows, *((100 + i, " ".join("other" if k % 7 == 3 else w for k, w in enumerate(t.split()))) for i, t in items)]
    bench = spark.createDataFrame([*items, (98, None), (99, "one two")], "item_id bigint, text string")
    one = sorted(map(tuple, dc.contaminated(docs(rows), bench).collect()))
    assert any(r[2] < 0.75 for r in one)
    for shard in (3, 11):
        assert sorted(map(tuple, dc.contaminated(docs(rows), bench, shard=shard).collect())) == one
    left = {r.doc_id for r in dc.decontaminate(docs(rows), bench, shard=5).collect()}
    assert left == {d for d, _ in rows} - {r[0] for r in one}


def test_short_items_and_scripts_without_spaces(spark, docs):
    chinese = "董事会每月第一天开会，并保存会议记录。"
    items = [(1, "Quick brown fox"), (2, "zebra"), (3, chinese), (4, "ที่ประชุมใหญ่สามัญประจำปี"), (5, "日本語"), (6, "!!!"), (7, "quick BROWN fox"), (8, "a b c d e f g h")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [
        (1, "the quick, brown fox runs"), (2, "quick red brown fox"), (3, "one zebra"), (4, "前言：" + chinese + "结束"), (5, "前言" + chinese.replace("，", "").replace("保存", "保管") + "end"),
        (6, "กขที่ประชุมใหญ่สามัญประจำปีกข"), (7, "これは日本語です"), (8, "日本の言語"), (9, "quick"), (10, "brown fox"), (11, "x a b c d e f g h y"), (12, ""),
    ]
    for shard in (50, 2):
        found = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in dc.contaminated(docs(rows), bench, shard=shard).collect()}
        assert set(found) == {(1, 1), (1, 7), (3, 2), (4, 3), (5, 3), (6, 4), (7, 5), (11, 8)}
        assert found[1, 1] == (1.0, 1, 3) and found[7, 5] == (1.0, 3, 3) and found[4, 3] == (1.0, 2, 17) and 0.6 <= found[5, 3][0] < 1
        assert {r.doc_id for r in dc.decontaminate(docs(rows), bench, shard=shard).collect()} == {2, 8, 9, 10, 12}
    only = bench.where("item_id = 2")
    assert [r.doc_id for r in dc.contaminated(docs(rows), only).collect()] == [3]


def test_every_block_probe_is_found():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (50, 2), dtype=np.uint64)
    for _ in range(200):
        a = base[int(r.integers(50))][None]
        b = a.copy()
        for bit in r.choice(128, dc.RADIUS, replace=False):
            b[0, bit // 64] ^= np.uint64(1 << int(bit % 64))
        assert any(int(dc._block(a, k)[0] ^ dc._block(b, k)[0]).bit_count() <= 1 for k in range(dc.BLOCKS))
    other = r.integers(0, 2**63, (400, 2), dtype=np.uint64) ^ (r.integers(0, 2, (400, 2), dtype=np.uint64) << np.uint64(63))
    pairs = [[np.bitwise_count(dc._block(base, k)[:, None] ^ dc._block(other, k)[None]) <= 1] for k in range(dc.BLOCKS)]
    assert np.any(pairs, axis=(0, 1)).mean() < 0.11  # blocks leave out most pairs


def test_similarity_definition():
    a, b = np.array([1, 1, 2], np.uint64), np.array([1, 3], np.uint64)
    assert dc.similarity(a, b, {1: 10, 2: 5}, 7) == 10 / (25 + 17 - 10)
    assert Counter(a.tolist())[1] == 2


def test_odd(spark, odd, none, docs):
    item = "The board meets on the first day of each month and keeps its minutes."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "two words"), (5, item)], "item_id bigint, text string")
    out = [(r.doc_id, r.item_id, r.similarity) for r in dc.contaminated(odd, bench).collect()]
    assert Counter(out) == Counter({(4, 1, 1.0): 2, (4, 5, 1.0): 2, (5, 1, 1.0): 1, (5, 5, 1.0): 1, (None, 1, 1.0): 1, (None, 5, 1.0): 1})
    kept = dc.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 2, 3, None, 6, 7, 8, 9, 10], key=str)
    empty = bench.where("item_id = 99")
    assert dc.contaminated(odd, empty).count() == 0 and dc.decontaminate(odd, empty).count() == 13
    assert dc.contaminated(none, bench).count() == 0
    part = item.split(" ", 1)[1]
    assert [r.item_id for r in dc.contaminated(docs([(1, part)]), bench.where("item_id = 1")).collect()] == [1]
