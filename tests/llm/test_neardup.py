import random
import re
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import neardup as nd
from lexmill.llm._text import buffers
from tests.conftest import compare


def brute(rows, radius=nd.RADIUS):
    """(doc_id, group_id, group_size, n_links) by fingerprints made word by word and all pairs of rows."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def fingerprint(text):
        sums = [0] * 128
        for w, n in Counter(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)).items():
            h = mixed(sum(b * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(w.encode())) & mask)
            for half in (0, 1):
                bits = mixed(h ^ mixed(half + 1))
                for i in range(64):
                    sums[64 * half + i] += n.bit_length() * (1 if bits >> i & 1 else -1)
        return sum(1 << i for i, x in enumerate(sums) if x > 0)

    rows = [(i, fingerprint(t)) for i, t in rows if i is not None and t is not None and re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", t)]
    near = [[False] * len(rows) for _ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= radius:
                near[a][b] = near[b][a] = True
                keep, lose = sorted((root[a], root[b]))
                root = [keep if r == lose else r for r in root]
    out = []
    for a, (i, _) in enumerate(rows):
        members = [rows[b][0] for b in range(len(rows)) if root[b] == root[a]]
        out.append((i, min(members), len(members), sum(near[a])))
    return sorted(out)


def same(found):
    return sorted((r.doc_id, r.group_id, r.group_size, r.n_links) for r in found.collect())


def test_trees_find_what_brute_force_finds():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, (60, 2), dtype=np.uint64)
    near = base.repeat(4, 0)
    for row in near:
        for bit in r.choice(128, int(r.integers(0, 25)), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    values = np.unique(np.concatenate([base, near]), axis=0)
    tree = r.integers(0, 5, len(values))
    asking, at = r.permutation(values), r.integers(0, 5, len(values))
    for radius in (0, 3, 20, 60):
        found = {(int(q), int(m)) for a, b in nd.BkForest(values, tree).search(asking, at, radius) for q, m in zip(a, b, strict=True)}
        d = np.bitwise_count(asking[:, None] ^ values[None]).sum(2)
        assert found == {(a, b) for a, b in np.argwhere(d <= radius).tolist() if at[a] == tree[b]}


def corpus(seed=0, families=25, singles=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    rows, truth, n = [], {}, 0
    for f in range(families):
        base = [word() for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(2, 6)):
            w = [word() if r.random() < 0.02 else x for x in base]
            rows.append((n, " ".join(w).capitalize() + "."))
            truth[n] = f
            n += 1
    for _ in range(singles):
        rows.append((n, " ".join(word() for _ in range(r.randint(30, 200)))))
        n += 1
    return rows, truth


def test_groups_against_brute_force(docs):
    rows, truth = corpus()
    found = {r.doc_id: r.group_id for r in nd.near_duplicates(docs(rows)).collect()}
    pairs = [(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]]
    assert np.mean([found.get(a, -1) == found.get(b, -2) for a, b in pairs]) > 0.95
    assert not set(found) - set(truth)
    want = brute(rows)
    assert same(nd.groups(docs(rows))) == want
    # Shards cut into pieces give the same.
    assert same(nd.groups(docs(rows), members=20)) == want
    # So does a radius that leaves blocks too narrow, for which trees are searched.
    assert same(nd.groups(docs(rows), radius=40, members=100)) == brute(rows, 40)


@pytest.mark.parametrize(("bits", "radius"), [(128, nd.RADIUS), (128, 0), (128, 7), (64, 12), (256, 20), (256, 60)])
def test_every_pair_within_the_radius_has_a_close_block(bits, radius):
    r = np.random.default_rng(3)
    a = r.integers(0, 2**64, (4000, bits // 64), dtype=np.uint64)
    b = a.copy()
    for row in b:
        for bit in r.choice(bits, radius, replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    close = [np.bitwise_count(nd._block(a ^ b, *x)) <= nd.SPARE for x in nd._Plan.of(bits, radius).blocks]
    assert np.any(close, axis=0).all()


def test_links_without_a_block_that_differs_in_one_bit(docs):
    """Pairs of 16 to 20 bits that differ in two bits or more in each of eight blocks of 16 bits."""
    r = random.Random(11)
    rows = []
    for f in range(1500):
        base = [f"w{r.randrange(5000)}" for _ in range(60)]
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(base[:-5] + [f"x{r.randrange(5000)}" for _ in range(5)]))]
    prints, _ = nd._signatures(*buffers(pa.array([t for _, t in rows])))
    apart = prints[::2] ^ prints[1::2]
    far = np.bitwise_count(apart).sum(1) <= nd.RADIUS
    far &= (np.bitwise_count(apart.view(np.uint16)) > 1).all(1)
    assert far.sum() >= 3
    rows = [x for f in np.flatnonzero(far).tolist() for x in rows[2 * f : 2 * f + 2]]
    found = same(nd.groups(docs(rows)))
    assert found == brute(rows)
    assert all(n for _, _, _, n in found)


def test_all_pairs_of_a_table(spark):
    """Every pair of fingerprints of a whole table, none left out."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    prints, some = nd._signatures(*buffers(pa.array([t for _, t in rows])))
    ids, prints = np.array([i for i, _ in rows])[some], prints[some]
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    near = d <= nd.RADIUS
    a, b = np.nonzero(near)
    root = nd._roots(len(ids), a, b)
    group = [ids[root == x].min() for x in root]
    want = sorted(zip(ids.tolist(), map(int, group), np.bincount(root)[root].tolist(), (near.sum(1) - 1).tolist(), strict=True))
    assert same(nd.groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))) == want


def test_same_rows_as_duckdb(spark, tiny):
    left, right = compare(spark, tiny, nd.query, nd.oracle())
    assert left == right and left[1]


def test_one_of_each_group_stays(docs):
    rows, truth = corpus(seed=4, families=8, singles=10)
    rows = rows + [rows[0], rows[0], (rows[0][0], "another text with the same number")]
    kept = nd.deduplicate(docs(rows))
    assert kept.columns == docs([]).columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(set(left))
    for f in set(truth.values()):
        assert [i for i, t in left if truth.get(i) == f and "another" not in t] == [min(i for i in truth if truth[i] == f)]
    assert sum(i not in truth for i, _ in left) == 10 and any("another" in t for _, t in left)


def test_big_group(docs):
    rows, _ = corpus(seed=9, families=0, singles=1)
    base = rows[0][1].split()
    many = [(i, " ".join(base[:-1] + [f"end{i % 400}"])) for i in range(1500)]
    out = nd.near_duplicates(docs(many)).collect()
    assert len(out) == 1500 and {r.group_id for r in out} == {0} and {r.group_size for r in out} == {1500}
    assert [r.doc_id for r in out if r.keep] == [0]
    assert {r.n_links for r in out} == {1499}
    # Shards whole and cut, in batches that cut them besides.
    prints = np.unique(nd._signatures(*buffers(pa.array([t for _, t in many])))[0], axis=0)
    table = pa.record_batch([nd._binary(prints), pa.array(np.ones(len(prints), np.int64))], ["fingerprint", "n"])
    plan = nd._Plan.of(128, nd.RADIUS)
    counts = np.array([np.bincount(nd._block(prints, first, width) >> (width - nd.HIGH), minlength=1 << nd.HIGH) for first, width in plan.blocks])
    for members in (nd.MEMBERS, 7):
        dealt = plan.dealt(counts, members)
        assert bool(dealt.crowded) == (members == 7)
        rows = pa.Table.from_batches(nd._shards(iter([table]), dealt)).sort_by([("shard", "ascending"), ("piece", "ascending")])
        found = pa.Table.from_batches(list(nd._link(iter(rows.to_batches(max_chunksize=17)), dealt)))
        links = {}
        for f, k in zip(found["fingerprint"].to_pylist(), found["links"].to_pylist(), strict=True):
            links[f] = links.get(f, 0) + k
        assert set(links.values()) == {len(prints) - 1} and len(links) == len(prints)


def test_rows_sent_at_six_gigabytes():
    """Where there are three million fingerprints, each is sent about 50 times; it was about 72 times at every size."""
    plan = nd._Plan.of(128, nd.RADIUS)
    dealt = plan.dealt(np.full((len(plan.blocks), 1 << nd.HIGH), 3_000_000 >> nd.HIGH), nd.MEMBERS)
    prints = np.random.default_rng(5).integers(0, 2**64, (2000, 2), dtype=np.uint64)
    table = pa.record_batch([nd._binary(prints), pa.array(np.ones(len(prints), np.int64))], ["fingerprint", "n"])
    assert sum(x.num_rows for x in nd._shards(iter([table]), dealt)) < 55 * len(prints)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 40), (40, 70), (70, 100), (5, 5)]
    out = {(r.node, r.root) for r in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {(i, 0) for i in range(1, 31)} | {(70, 40), (100, 40)}


def test_odd(odd, none):
    out = [tuple(r) for r in nd.near_duplicates(odd).collect()]
    assert sorted(out) == [(4, 4, 3, 2, True), (4, 4, 3, 2, True), (5, 4, 3, 2, False)]
    kept = [r.doc_id for r in nd.deduplicate(odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, None, None, 6, 7, 8, 9, 10], key=str)
    assert nd.near_duplicates(none).count() == 0 and nd.deduplicate(none).count() == 0


def test_what_asks_alike_is_compared_at_once(monkeypatch):
    """Crowded blocks give all pairs, each once, in less time than one member at a time; rows packed for the shuffle come back whole."""
    r = np.random.default_rng(6)
    plan = nd._Plan.of(128, nd.RADIUS)
    prints = np.zeros((3000, 2), np.uint64)
    prints[:, 1] = r.integers(0, 2**64, 3000, dtype=np.uint64)
    prints[:, 0] = r.integers(0, 2**64, 3000, dtype=np.uint64) << np.uint64(18) | r.integers(0, 8, 3000).astype(np.uint64)
    near = prints[:1000].copy()
    for row in near:
        for bit in r.choice(128, int(r.integers(1, 22)), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    prints = np.unique(np.concatenate([prints, near]), axis=0)
    counts = np.array([np.bincount(nd._block(prints, first, width) >> (width - nd.HIGH), minlength=1 << nd.HIGH) for first, width in plan.blocks])
    table = pa.record_batch([nd._binary(prints), pa.array(np.arange(len(prints)))], ["fingerprint", "n"])
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = {(a, b) for a, b in np.argwhere(d <= nd.RADIUS).tolist() if a < b}
    for members in (nd.MEMBERS, 700):
        dealt = plan.dealt(counts, members)
        plain = pa.Table.from_batches(nd._shards(iter([table]), dealt))
        packed = pa.Table.from_batches(nd._packed(nd._shards(iter([table]), dealt)))
        assert packed.num_rows < plain.num_rows / 10
        rows = pa.Table.from_batches(nd._unpacked(iter(packed.to_batches(max_chunksize=5)), 128))
        by = [(x, "ascending") for x in ("shard", "piece", "role", "fingerprint", "n")]
        assert rows.num_rows == plain.num_rows and rows.sort_by(by).to_pydict() == plain.sort_by(by).to_pydict()
        found = []
        shard, piece, role, values, n = (np.concatenate(x) for x in zip(*map(nd._arrays, rows.to_batches()), strict=True))
        for s, p in {*zip(shard.tolist(), piece.tolist(), strict=True)}:
            own = np.flatnonzero((shard == s) & (piece == p))
            for q, m in nd._near(s, role[own], values[own], dealt):
                found += [(s >> nd.HIGH, *sorted(x)) for x in zip(n[own[q]].tolist(), n[own[m]].tolist(), strict=True)]
        assert len(found) == len(set(found)) and {x[1:] for x in found} == want

    crowd = r.integers(0, 2**64, (20_000, 2), dtype=np.uint64)
    crowd[:, 0] = crowd[:, 0] << np.uint64(18) | r.integers(0, 8, len(crowd)).astype(np.uint64)
    crowd[::2] = crowd[1::2] ^ np.array([1 << 40, 1 << 50], np.uint64)

    def seconds():
        began = time.process_time()
        pairs = sum(len(q) for q, _ in nd._near(0, np.zeros(len(crowd), np.int8), crowd, replace(plan, high=2)))
        return time.process_time() - began, pairs

    quick = min(seconds() for _ in range(3))
    monkeypatch.setattr(nd, "ALIKE", 1 << 40)
    slow = min(seconds() for _ in range(3))
    assert quick[1] == slow[1] == len(crowd) // 2 and quick[0] < slow[0] / 1.4
