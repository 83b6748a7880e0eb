"""Benchmark decontamination: SimHash of item-sized windows, verified exactly.

A window of a document has as many words as an item of the benchmark. Its fingerprint has
BITS bits, each the sign of a sum over its words, and is looked up by blocks: with BLOCKS
blocks and all block values one bit apart probed, every item fingerprint within
RADIUS = 2 * BLOCKS - 1 bits is found. What is found is verified by the weighted Jaccard
similarity of word pairs. Windows that hold too little weight of word pairs of the
benchmark can't reach that similarity with any item of their size and get no fingerprint.
Items too short for that are looked up by the hash of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import LOOSE, LOOSE_SQL, Words, buffers, hashes_sql, mix, mix_sql, parted, prefix, ragged, slices, span_hash, table

BITS, BLOCKS = 128, 12
RADIUS = 2 * BLOCKS - 1
#: Least weighted similarity of a hit; an item of fewer words is matched exactly.
SIMILARITY, LEAST_WORDS = 0.6, 5
#: Items whose index is held and sent to the executors at once; a larger benchmark takes several passes, with the same results.
SHARD = 50_000
_EDGES = np.linspace(0, BITS, BLOCKS + 1).round().astype(np.int64)
#: Words whose sums of bits are held at once.
_SPAN = 1 << 15


#: Characters of scripts without spaces, each a word, and their punctuation, which separates: first and last.
_ALONE = ((0xE00, 0x109F), (0x1780, 0x17FF), (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_APART = ((0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def tokens(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 22) -> Words:
    """LOOSE words, of which those in scripts without spaces are cut into characters; a long document's in parts."""
    return parted(_tokens, data, offsets, LOOSE, limit)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    w = Words(data, offsets, LOOSE)
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return w
    low = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F
    wide = data[lead] >= 0xF0
    size = np.where(wide, 4, 3)
    head = data[lead].astype(np.int64)
    point = np.where(wide, (head & 7) << 18 | low(1) << 12 | low(2) << 6 | low(3), (head & 15) << 12 | low(1) << 6 | low(2))
    apart = np.logical_or.reduce([(point >= a) & (point <= b) for a, b in _APART])
    cut = apart | np.logical_or.reduce([(point >= a) & (point <= b) for a, b in _ALONE])
    if not cut.any():
        return w
    begin = lead[cut]
    after = begin + size[cut]
    after = after[after < w.end[np.searchsorted(w.start, begin, "right") - 1]]
    start = np.unique(np.concatenate([w.start, begin, after]))
    end = np.minimum(np.append(start[1:], len(data)), w.end[np.searchsorted(w.start, start, "right") - 1])
    keep = ~np.isin(start, lead[apart])
    w.start, w.end = start[keep], end[keep]
    w.row = np.searchsorted(w.start, offsets)
    w.hash = span_hash(prefix(LOOSE[data]), w.start, w.end)
    return w


def _run_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row."""
    out = hashes[: max(len(hashes) - n + 1, 0)]
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out


def _pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; none for a single word."""
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _block(fingerprints: np.ndarray, b: int) -> np.ndarray:
    width = int(_EDGES[b + 1] - _EDGES[b])
    return ((fingerprints[:, _EDGES[b] // 64] >> np.uint64(_EDGES[b] % 64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """1 or -1 for each bit of words."""
    halves = [np.unpackbits(mix(hashes ^ np.uint64(k + 1)).view(np.uint8).reshape(-1, 8), axis=1) for k in range(BITS // 64)]
    return np.concatenate(halves, axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(len(sums), -1)


@dataclass
class Benchmark:
    """The index of a benchmark's items, sent to every executor."""

    ids: list
    length: np.ndarray  # words
    shingles: list[np.ndarray]  # of each item, sorted
    known: np.ndarray  # all shingles of these items and those of several items of the whole benchmark, sorted
    weight: np.ndarray  # of each of known, scaled to integers
    most: int  # the weight of a shingle that no item has
    total: np.ndarray  # weight of each item
    fingerprint: np.ndarray  # a row each
    filter: np.ndarray  # bits of known shingles, by their upper bits
    shift: int
    short_ids: list  # items of fewer than LEAST_WORDS words, numbered after ids
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by their words: hashes, sorted, and numbers

    def probes(self, size: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Items of size words and, for each block, where those begin whose value is a given one but for one bit, and who they are."""
        known = self.__dict__.setdefault("_probes", {})
        if size not in known:
            items = np.flatnonzero(self.length == size)
            blocks = []
            for b in range(BLOCKS):
                width = int(_EDGES[b + 1] - _EDGES[b])
                values = _block(self.fingerprint[items], b)
                near = np.concatenate([values, *(values ^ (1 << k) for k in range(width))])
                who = np.tile(np.arange(len(items)), width + 1)
                order = np.argsort(near, kind="stable")
                blocks.append((np.searchsorted(near[order], np.arange((1 << width) + 1)), who[order]))
            known[size] = items, blocks
        return known[size]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """Weights of shingles, and 0 for those that no item has."""
        maybe = np.flatnonzero(self.filter[(shingles >> np.uint64(self.shift)).astype(np.int64)])
        out = np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        hit = self.known[at] == shingles[maybe]
        out[maybe[hit]] = self.weight[at[hit]]
        return out


@dataclass
class Frequencies:
    """What the weights of a benchmark's word pairs follow from; a pair that isn't here is in one item at most."""

    items: int
    pair: np.ndarray  # pairs that several items have, sorted
    count: np.ndarray  # items that have them


def frequencies(benchmark: DataFrame) -> Frequencies:
    """The number of items that take part, and in how many of them word pairs are that several have."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tokens(*buffers(batch.column(0)))
            kept = [w.hash[a:b] for a, b in zip(w.row[:-1], w.row[1:], strict=True) if b - a >= LEAST_WORDS]
            found = np.concatenate([np.zeros(0, np.uint64), *(np.unique(_pairs_of(h)) for h in kept)])
            # The null pair stands for items.
            column = pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(len(kept), pa.int64())])
            yield pa.RecordBatch.from_arrays([column], ["pair"])

    counted = benchmark.select("text").mapInArrow(pairs, "pair bigint").groupBy("pair").agg(F.count("*").alias("n"))
    rows = counted.where("n > 1 OR pair IS NULL").toArrow()
    pair, n = rows["pair"].combine_chunks(), rows["n"].to_numpy()
    null = np.asarray(pair.is_null())
    hashes = pair.fill_null(0).to_numpy()[~null].view(np.uint64)
    order = np.argsort(hashes)
    return Frequencies(int(n[null].sum()), hashes[order], n[~null][order])


def index(ids: list, texts: pa.Array, whole: Frequencies | None = None) -> Benchmark | None:
    """The index of items; those that are null or without words take no part.

    Where the items are a part of a benchmark, their weights follow from the frequencies of the whole.
    """
    data, offsets = buffers(texts)
    w = tokens(data, offsets)
    length = np.diff(w.row)
    keep = np.flatnonzero(length >= LEAST_WORDS).tolist()
    brief = np.flatnonzero((length > 0) & (length < LEAST_WORDS))
    if not keep and not len(brief):
        return None
    short = {}
    for size in np.unique(length[brief]).tolist():
        which = np.flatnonzero(length[brief] == size)
        hashes = np.array([_run_of(w.hash[w.row[r] : w.row[r + 1]], size)[0] for r in brief[which]], np.uint64)
        order = np.argsort(hashes, kind="stable")
        short[size] = hashes[order], len(keep) + which[order]
    short_ids = [ids[r] for r in brief]
    if not keep:
        none = np.zeros(0, np.int64)
        return Benchmark([], none, [], none.view(np.uint64), none, 0, none, np.zeros((0, BITS // 64), np.uint64), np.zeros(1 << 12, bool), 52, short_ids, short)
    shingles = [np.sort(_pairs_of(w.hash[w.row[r] : w.row[r + 1]])) for r in keep]
    known, items = np.unique(np.concatenate([np.unique(s) for s in shingles]), return_counts=True)
    n = len(keep)
    if whole is not None:
        n = whole.items
        known = np.union1d(known, whole.pair)
        items = np.ones(len(known), np.int64)
        items[np.searchsorted(known, whole.pair)] = whole.count
    weight = np.round(1000 * np.log1p(n / items)).astype(np.int64)
    at = [np.searchsorted(known, s) for s in shingles]
    bits = max(12, int(np.ceil(np.log2(len(known) * 16))))
    filter_ = np.zeros(1 << bits, bool)
    filter_[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
    sums = np.stack([_signs(w.hash[w.row[r] : w.row[r + 1]]).sum(0, dtype=np.int64) for r in keep])
    total = np.array([weight[a].sum() for a in at])
    return Benchmark([ids[r] for r in keep], length[keep], shingles, known, weight, int(round(1000 * np.log1p(n))), total, _fingerprint(sums), filter_, 64 - bits, short_ids, short)


def similarity(item: np.ndarray, window: np.ndarray, weight_of: dict[int, int], most: int) -> float:
    """Weighted Jaccard similarity of two multisets of shingles; the definition, for tests."""
    from collections import Counter

    a, b = Counter(item.tolist()), Counter(window.tolist())
    w = lambda s: weight_of.get(s, most)
    both = sum(w(s) * min(n, b[s]) for s, n in a.items())
    return both / (sum(w(s) * n for s, n in a.items()) + sum(w(s) * n for s, n in b.items()) - both)


def _hits(hashes: np.ndarray, edges: np.ndarray, bench: Benchmark, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start word, words, item and similarity of every verified window of documents."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    n = len(hashes)
    if n < 2:
        return none
    shingles = _pairs_of(hashes)
    inside = np.ones(n - 1, bool)
    cut = edges[1:-1]
    inside[cut[(cut > 0) & (cut < n)] - 1] = False
    weight = bench.weights(shingles)
    weight[~inside] = 0
    sums = np.concatenate([[0], np.cumsum(weight), [0]])
    sums[-1] = sums[-2]
    stop = np.repeat(edges[1:], np.diff(edges))
    found: list[tuple[np.ndarray, ...]] = []
    starts_of, ends_of, length_of = [], [], []
    if not weight.any():
        return none
    for length in np.unique(bench.length):
        need = least * bench.total[bench.length == length].min()
        end = np.minimum(np.arange(n) + length, stop)
        ok = np.flatnonzero(sums[np.maximum(end - 1, 0)] - sums[:n] >= need)
        if len(ok):
            starts_of.append(ok)
            ends_of.append(end[ok])
            length_of.append(np.full(len(ok), length))
    if not starts_of:
        return none
    start, end, length = (np.concatenate(x) for x in (starts_of, ends_of, length_of))
    order = np.argsort(start, kind="stable")
    start, end, length = start[order], end[order], length[order]
    # A window's true weight needs its unknown shingles too: only now, for the windows that are left.
    full = np.where(weight > 0, weight, bench.most)
    full[~inside] = 0
    totals = np.concatenate([[0], np.cumsum(full)])
    lo = 0
    while lo < len(start):
        hi = int(np.searchsorted(start, start[lo] + _SPAN))
        marks = _prints_of(hashes, start[lo:hi], end[lo:hi])
        for size in np.unique(length[lo:hi]):
            which = np.flatnonzero(length[lo:hi] == size)
            for window, item in _candidates(marks[which], bench, size):
                found += _verified(which[window] + lo, item, start, end, shingles, totals, bench, least)
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


def _prints_of(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of windows of words."""
    base = start[0]
    cover = np.zeros(end.max() - base + 1, np.int64)
    np.add.at(cover, start - base, 1)
    np.add.at(cover, end - base, -1)
    used = np.flatnonzero(np.cumsum(cover) > 0)
    place = np.zeros(len(cover) + 1, np.int64)
    place[used + 1] = 1
    place = np.cumsum(place)  # used words before a word
    sums = np.zeros((len(used) + 1, BITS), np.int32)
    np.cumsum(_signs(hashes[used + base]), axis=0, dtype=np.int32, out=sums[1:])
    return _fingerprint(sums[place[end - base]] - sums[place[start - base]])


def _candidates(marks: np.ndarray, bench: Benchmark, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, item) numbers within RADIUS, some windows at a time."""
    items, blocks = bench.probes(size)
    step = max(1, (1 << 22) // len(items))
    for a in range(0, len(marks), step):
        some = marks[a : a + step]
        pairs = []
        for b, (first, who) in enumerate(blocks):
            value = _block(some, b)
            count = first[value + 1] - first[value]
            pairs.append(np.repeat(np.arange(len(some)), count) * len(items) + who[np.repeat(first[value], count) + ragged(count)])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(items), items[pair % len(items)]
        close = np.bitwise_count(some[window] ^ bench.fingerprint[item]).sum(1) <= RADIUS
        yield window[close] + a, item[close]


def _verified(window: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray, shingles: np.ndarray, totals: np.ndarray, bench: Benchmark, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Start word, words, item and similarity of the pairs that are similar enough."""
    for i in np.unique(item):
        each = window[item == i]
        own, tf = np.unique(bench.shingles[i], return_counts=True)
        w_own = bench.weight[np.searchsorted(bench.known, own)]
        for a in range(0, len(each), 1 << 14):
            s, e = start[each[a : a + (1 << 14)]], end[each[a : a + (1 << 14)]]
            width = np.arange(bench.length[i] - 1)
            span = np.minimum(s[:, None] + width, len(shingles) - 1)
            block = shingles[span]
            pos = np.minimum(np.searchsorted(own, block), len(own) - 1)
            r, c = np.nonzero((width < (e - s - 1)[:, None]) & (own[pos] == block))
            counts = np.bincount(r * len(own) + pos[r, c], minlength=len(s) * len(own)).reshape(len(s), len(own))
            both = (np.minimum(counts, tf) * w_own).sum(1)
            total = totals[e - 1] - totals[s]
            score = both / (bench.total[i] + total - both)
            good = score >= least
            yield s[good], (e - s)[good], np.full(int(good.sum()), i), score[good]


def _short_hits(hashes: np.ndarray, edges: np.ndarray, bench: Benchmark) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What _hits gives, for the items that are matched exactly."""
    stop = np.repeat(edges[1:], np.diff(edges))
    for size, (known, numbers) in bench.short.items():
        runs = _run_of(hashes, size)
        first = np.searchsorted(known, runs)
        start = np.flatnonzero((known[np.minimum(first, len(known) - 1)] == runs) & (np.arange(len(runs)) + size <= stop[: len(runs)]))
        count = np.searchsorted(known, runs[start], "right") - first[start]
        item = numbers[np.repeat(first[start], count) + ragged(count)]
        start = np.repeat(start, count)
        yield start, np.full(len(start), size), item, np.ones(len(start))


def _all_hits(hashes: np.ndarray, edges: np.ndarray, bench: Benchmark, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = [_hits(hashes, edges, bench, least), *_short_hits(hashes, edges, bench)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(batches: Iterator[pa.RecordBatch], bench: Benchmark, least: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item", "similarity", "start_word", "n_words"]
    for batch in batches:
        ids = batch.column(0)
        data, offsets = buffers(batch.column(1))
        for a, b in slices(offsets):
            w = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            start, size, item, score = _all_hits(w.hash, w.row, bench, least)
            if not len(start):
                continue
            row = np.searchsorted(w.row, start, "right") - 1
            order = np.lexsort((size, start, -score, item, row))
            first = np.ones(len(order), bool)
            first[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
            top = order[first]
            columns = [ids.take(pa.array(row[top] + a)), pa.array(item[top], pa.int32()), pa.array(score[top]), pa.array((start - w.row[row])[top].astype(np.int32)), pa.array(size[top].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names)


def _indexes(benchmark: DataFrame, shard: int) -> Iterator[Benchmark]:
    """Indexes of shard items or so each, read one after the other."""
    passes = max(1, -(-benchmark.count() // shard))
    whole = frequencies(benchmark) if passes > 1 else None
    for p in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).select("item_id", "text")
        rows = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        bench = index(rows["item_id"].to_pylist(), rows["text"].combine_chunks(), whole) if len(rows) else None
        if bench is not None:
            yield bench


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text: str = "text", key: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window for each document and item it holds.

    A document holds an item if one of its windows has a fingerprint within RADIUS bits of
    the item's and a similarity of at least least; of those windows the best is given.

    Words are runs of ASCII letters and digits and of other letters, in lower case; in
    scripts without spaces, each character is a word and their punctuation separates. Of
    equally similar windows the first and then the shortest counts. A window is cut off at
    the end of its document, so that a document that is a part of an item can match. A
    null text, an empty one and one of a single word have no rows; a null doc_id stays
    null; rows with a doc_id that repeats give a row each. Items of fewer than
    LEAST_WORDS words match only where all their words stand in a row, with similarity 1;
    even an item of one word matches wherever that word stands. Items that are null or
    without words take no part; of items with one item_id each takes part. An empty benchmark gives an empty result,
    and so does an empty table of documents. Whole texts are read, however long.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    id_kind = benchmark.schema["item_id"].dataType.simpleString()
    spark = docs.sparkSession
    out = None
    for bench in _indexes(benchmark, shard):
        sent = spark.sparkContext.broadcast(bench)
        hits = source.mapInArrow(lambda x, sent=sent: _scan(x, sent.value, least), f"doc_id {kind}, item int, similarity double, start_word int, n_words int")
        numbers = spark.createDataFrame([(i, v) for i, v in enumerate([*bench.ids, *bench.short_ids])], f"item int, item_id {id_kind}")
        hits = hits.join(F.broadcast(numbers), "item").select("doc_id", "item_id", "similarity", "start_word", "n_words")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, item_id {id_kind}, similarity double, start_word int, n_words int")


def clean(text: Column, sent: Broadcast, least: float = SIMILARITY) -> Column:
    """Whether a text holds none of the items of a broadcast index; true for null."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        out = np.ones(len(texts), bool)
        for a, b in slices(offsets):
            w = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            start = _all_hits(w.hash, w.row, sent.value, least)[0]
            out[np.searchsorted(w.row, start, "right") - 1 + a] = False
        return pa.array(out)

    return run.asNondeterministic()(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, text: str = "text", shard: int = SHARD) -> DataFrame:
    """The rows of docs that hold no item of the benchmark; see contaminated. Null texts stay."""
    for bench in _indexes(benchmark, shard):
        docs = docs.where(clean(F.col(text), docs.sparkSession.sparkContext.broadcast(bench), least))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "benchmark")))


def oracle(least: float = SIMILARITY, radius: int = RADIUS) -> str:
    """The same rows in DuckDB, for items of LEAST_WORDS words or more in scripts with spaces: every window that holds enough weight, in full."""
    pairs = "SELECT {0}, unnest(range(len(ws) - 1)) AS p, unnest(list_zip(ws[:-2], ws[2:])) AS pair, n FROM {1} WHERE n > 1"
    signs = f"""SELECT {{0}}, sum(CASE WHEN one1 > 0 THEN 1::HUGEINT << b ELSE 0 END) AS p1, sum(CASE WHEN one2 > 0 THEN 1::HUGEINT << b ELSE 0 END) AS p2 FROM (
    SELECT {{0}}, b, sum(((h1 >> b) & 1)::INT * 2 - 1) AS one1, sum(((h2 >> b) & 1)::INT * 2 - 1) AS one2
    FROM (SELECT {{0}}, w, unnest(range({BITS // 2})) AS b FROM {{1}}) JOIN two USING (w) GROUP BY ALL) GROUP BY ALL"""
    return f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, {LOOSE_SQL.format("text")} AS ws, len(ws) AS n FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT row_number() OVER () AS i, item_id, {LOOSE_SQL.format("text")} AS ws, len(ws) AS n FROM benchmark WHERE text IS NOT NULL AND len({LOOSE_SQL.format("text")}) >= {LEAST_WORDS}
), weights AS (
  SELECT pair, round(1000 * ln(1 + (SELECT count(*) FROM items) / count(DISTINCT i)))::BIGINT AS weight FROM ({pairs.format("i", "items")}) GROUP BY pair
), own AS (
  SELECT i, pair, count(*) AS tf, any_value(weight) AS weight FROM ({pairs.format("i", "items")}) JOIN weights USING (pair) GROUP BY i, pair
), totals AS (
  SELECT i, n, sum(tf * weight)::BIGINT AS total FROM own JOIN items USING (i) GROUP BY i, n
), placed AS (
  SELECT r, p, n, pair, weight, coalesce(weight, round(1000 * ln(1 + (SELECT count(*) FROM items)))::BIGINT) AS full_weight FROM ({pairs.format("r", "texts")}) LEFT JOIN weights USING (pair)
), sums AS (
  SELECT r, p + 1 AS p, n, sum(coalesce(weight, 0)) OVER w AS known, sum(full_weight) OVER w AS whole FROM placed WINDOW w AS (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT r, 0, n, 0, 0 FROM texts WHERE n > 1
), eligible AS (
  SELECT r, i, any_value(total) AS total, any_value(totals.n) AS n
  FROM (SELECT d.r, o.i, any_value(o.weight) * least(any_value(o.tf), count(*)) AS shared FROM placed d JOIN own o USING (pair) GROUP BY d.r, o.i, o.pair) JOIN totals USING (i)
  GROUP BY r, i HAVING sum(shared) >= {least} * any_value(total)
), windows AS (
  SELECT a.r, a.p AS s, least(a.p + t.n, a.n) AS e, t.i, t.total, b.known - a.known AS known, b.whole - a.whole AS whole
  FROM eligible t JOIN sums a ON a.r = t.r JOIN sums b ON b.r = a.r AND b.p = greatest(least(a.p + t.n, a.n) - 1, a.p) WHERE b.known - a.known >= {least} * t.total
), common AS (
  SELECT r, s, e, i, sum(weight * least(tf, c))::BIGINT AS shared
  FROM (SELECT x.r, s, e, x.i, o.pair, o.tf, o.weight, count(*) AS c FROM windows x JOIN placed d ON d.r = x.r AND d.p >= s AND d.p < e - 1 JOIN own o ON o.i = x.i AND o.pair = d.pair GROUP BY ALL) GROUP BY ALL
), scored AS (
  SELECT r, s, e, i, shared / (total + whole - shared) AS similarity FROM common JOIN windows USING (r, s, e, i) WHERE shared / (total + whole - shared) >= {least}
), found AS (
  SELECT DISTINCT r, s, e FROM scored
), inside AS (
  SELECT f.r, f.s, f.e, unnest(ws[s + 1:e]) AS w FROM found f JOIN texts USING (r)
), said AS (
  SELECT i, unnest(ws) AS w FROM items
), {hashes_sql("SELECT w FROM inside UNION SELECT w FROM said")}, two AS (
  SELECT w, {mix_sql("xor(h, 1::UBIGINT)")} AS h1, {mix_sql("xor(h, 2::UBIGINT)")} AS h2 FROM hashed
), marks AS (
  {signs.format("r, s, e", "inside")}
), prints AS (
  {signs.format("i", "said")}
), near AS (
  SELECT r, i, s, e, similarity FROM scored JOIN marks USING (r, s, e) JOIN prints USING (i) WHERE bit_count(xor(marks.p1, prints.p1)) + bit_count(xor(marks.p2, prints.p2)) <= {radius}
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, i ORDER BY similarity DESC, s, e - s) AS k FROM near
)
SELECT doc_id, item_id, similarity, s::INT AS start_word, (e - s)::INT AS n_words FROM best JOIN texts USING (r) JOIN items USING (i) WHERE k = 1"""
