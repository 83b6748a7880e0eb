"""Repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A passage is LENGTH words. Every passage has an anchor: the word group in it whose hash
is least. Neighbouring passages with one anchor make a segment, and equal passages have
equal anchors, so that the passages under one anchor can be compared on their own: a text
is cut into segments, and only anchors that occur at least twice go on. Where all
segments of an anchor are equal, all their passages repeat. Where they differ, one of
each kind is joined, a suffix array and its Burrows-Wheeler transform are built, and
intervals are extended backwards, breadth first: common prefixes come by increasing
length, and what none below LENGTH separates is one repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm._text import EXACT, buffers, prefix, ragged, slices, sliding_min, span_hash, stash, table, words

#: Words of a passage, and of the groups among which its anchor is chosen.
LENGTH, GROUP = 50, 8
#: Words whose transform is built at once, unless one anchor has more.
BLOCK = 1 << 19
#: Kinds of segments that one anchor may have for them to be transformed together; passages of others are counted one by one.
KINDS = 50_000


def _segments(hashes: np.ndarray, edges: np.ndarray, length: int, group: int) -> tuple[np.ndarray, ...]:
    """Anchor, row, first passage, passages, and content hash of each segment."""
    group = min(group, length)
    n = len(hashes) - length + 1
    size = np.diff(edges)
    passages = np.maximum(size - length + 1, 0)
    if n <= 0 or not passages.any():
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    sums = prefix(hashes)
    m = len(hashes) - group + 1
    grams = span_hash(sums, np.arange(m), np.arange(m) + group)
    low = np.uint64((1 << 28) - 1)
    key = (grams & ~low) | np.arange(m, dtype=np.uint64)
    best = (sliding_min(key, length - group + 1) & low).astype(np.int64)
    live = np.flatnonzero(passages)
    start = np.repeat(edges[live], passages[live]) + ragged(passages[live])
    row = np.repeat(live, passages[live])
    at = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    content = span_hash(sums, begin, begin + count + length - 1)
    return grams[at[first]], row[first], begin - edges[row[first]], count, content


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of integers by their first depth values at least, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    h = 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        h *= 2
    return order


def bounded_lcp(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Longest common prefixes of neighbouring suffixes that are below depth; -1 for all others.

    Entry i is for order[i - 1] and order[i]. An interval holds the suffixes that begin
    with one string; extending it backwards by a symbol of the transform gives the
    interval of a string longer by one. Intervals are extended level by level, and the
    first that ends before entry i has the length of that common prefix (Beller, Gog,
    Ohlebusch and Schnattinger, 2013). Depth ends the levels.
    """
    n = len(text)
    symbol = text[order - 1]  # the transform, the text being a circle
    by_symbol = np.argsort(symbol, kind="stable")  # last-to-first mapping: entry of the k-th row
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    begin, end = np.array([0]), np.array([n])
    for level in range(depth):
        if not len(begin):
            break
        width = end - begin
        row = np.repeat(begin, width) + ragged(width)
        target = np.sort(to[row])
        source = by_symbol[target]
        owner = np.searchsorted(begin, source, "right")
        cut = np.ones(len(target), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (symbol[source][1:] != symbol[source][:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(target)) - 1
        stop = target[last] + 1
        fresh = lcp[stop] == -1
        lcp[stop[fresh]] = level
        begin, end = target[first][fresh], stop[fresh]
    return lcp[:n]


def _shared(pieces: list[np.ndarray], weight: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of repeated passages in segments: segment, first, end, and whether they are the first of their kind."""
    sizes = np.array([len(p) for p in pieces])
    _, code = np.unique(np.concatenate(pieces), return_inverse=True)
    n = len(pieces)
    edges = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(int(sizes.sum()) + n, np.int64)
    body = np.ones(len(text), bool)
    body[edges + sizes] = False
    text[body] = code + n
    text[edges + sizes] = np.arange(n)  # each segment ends in a symbol of its own
    order = suffix_array(text, length)
    lcp = bounded_lcp(text, order, length)
    kind = np.cumsum(lcp >= 0)  # entries that no shorter prefix separates
    owner = np.searchsorted(edges, order, "right") - 1
    at = order - edges[owner]
    whole = at + length <= sizes[owner]
    kind, owner, at = kind[whole], owner[whole], at[whole]
    if not len(kind):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    total = np.bincount(kind, weight[owner])
    sort = np.lexsort((start[owner] + at, doc[owner], kind))
    lead = np.ones(len(sort), bool)
    lead[1:] = kind[sort][1:] != kind[sort][:-1]
    first = np.zeros(len(kind), bool)
    first[sort[lead]] = True
    hit = total[kind] >= 2
    owner, at, first = owner[hit], at[hit], first[hit]
    sort = np.lexsort((at, owner))
    owner, at, first = owner[sort], at[sort], first[sort]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(owner)) - 1
    return owner[lead], at[lead], at[last] + 1, first[lead]


def _cut(batches: Iterator[pa.RecordBatch], length: int, group: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, offsets = buffers(batch.column(1))
        for a, b in slices(offsets):
            w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], EXACT)
            anchor, row, begin, count, content = _segments(w.hash, w.row, length, group)
            columns = [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), ids.take(pa.array(row + a)), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc_id", "first", "passages"])


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words of wanted segments of documents; batches: text, list of (anchor, content, doc_id, first, passages, copies)."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        lists = batch.column(1)
        want = lists.flatten()
        edge = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        content, first, passages = (np.asarray(want.field(k)) for k in ("content", "first", "passages"))
        for a, b in slices(offsets):
            w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], EXACT)
            lo, hi = edge[a], edge[b]
            row = np.repeat(np.arange(b - a), np.diff(edge[a : b + 1]))
            start = w.row[row] + first[lo:hi]
            end = start + passages[lo:hi] + length - 1
            fits = end <= w.row[row + 1]
            sums = prefix(w.hash)
            same = fits.copy()
            same[fits] = span_hash(sums, start[fits], end[fits]).view(np.int64) == content[lo:hi][fits]
            start, end = start[same], end[same]
            part = want.slice(lo, hi - lo).filter(pa.array(same))
            sizes = end - start
            flat = w.hash[np.repeat(start, sizes) + ragged(sizes)]
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(part.field(k) for k in ("anchor", "content", "doc_id", "first", "copies")), pa.ListArray.from_arrays(cuts, pa.array(flat.view(np.int64)))], ["anchor", "content", "doc_id", "first", "copies", "body"])


def _expand(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated passages; the input is sorted by anchor."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        anchor, content, doc, first, copies = (np.asarray(t[k].combine_chunks()) for k in ("anchor", "content", "doc_id", "first", "copies"))
        doc = np.unique(doc, return_inverse=True)[1]  # by rank: ids may be strings
        body = t["body"].combine_chunks()
        flat, sizes = np.asarray(body.flatten()), np.asarray(body.value_lengths())
        # Repeated doc_ids can fetch one segment twice.
        new = np.ones(len(anchor), bool)
        order = np.lexsort((content, anchor))
        new[order[1:]] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
        ends = np.cumsum(sizes)
        keep = np.flatnonzero(new)
        pieces = [flat[ends[i] - sizes[i] : ends[i]] for i in keep]
        who, a, b, lead = _shared(pieces, copies[keep], doc[keep], first[keep], length)
        who = keep[who]
        return pa.RecordBatch.from_arrays([pa.array(anchor[who]), pa.array(content[who]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(lead)], ["anchor", "content", "a", "b", "lead"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column(0))
        sizes = np.asarray(batch.column(5).value_lengths())
        edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != int(anchor[0]):
            edges = np.concatenate([[0], edges])
        at = 0
        total = np.cumsum(sizes)
        for e in edges.tolist():
            have = count + (total[e - 1] if e else 0) - (total[at - 1] if at else 0)
            if have >= BLOCK:
                if e > at:
                    held.append(batch.slice(at, e - at))
                yield solve(held)
                held, count, at = [], 0, e
        if at < batch.num_rows:
            held.append(batch.slice(at))
            count += int(total[-1] - (total[at - 1] if at else 0))
    if held:
        yield solve(held)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every passage of fetched segments, with a hash of its words."""
    for batch in batches:
        body = batch.column("body")
        flat, sizes = np.asarray(body.flatten()).view(np.uint64), np.asarray(body.value_lengths()).astype(np.int64)
        count = sizes - length + 1
        at = np.repeat(np.cumsum(sizes) - sizes, count) + ragged(count)
        hashes = span_hash(prefix(flat), at, at + length)
        row = pa.array(np.repeat(np.arange(batch.num_rows), count))
        kept = [batch.column(k).take(row) for k in ("anchor", "content", "doc_id", "first", "copies")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ragged(count).astype(np.int32)), pa.array(hashes.view(np.int64))], ["anchor", "content", "doc_id", "first", "copies", "a", "passage"])


def repeated_passages(docs: DataFrame, length: int = LENGTH, group: int = GROUP, text: str = "text", key: str = "doc_id", kinds: int = KINDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, is_first): runs of words that passages of length words cover which occur more than once.

    Words stand between ASCII white space, and compare exactly. Passages of one document
    that follow each other at every word and have the same is_first make one run. is_first
    tells the first occurrence, by doc_id and position, from the later ones, which a
    deduplication would cut. Whole texts are read, however long. A null doc_id, a null
    text and a text of fewer than length words have no rows, nor has an empty table. A row
    that repeats repeats its passages; runs of rows with one doc_id are merged. Other
    columns of docs aren't read. An anchor with more than kinds kinds of segments, as the
    end of a passage has that stands in very many documents, would fill one task: its
    passages are counted one by one instead, spread by their hashes.

    What repeats is counted before it is shuffled, and the joins that bring counts back to
    segments can be split where one anchor has very many.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    kind = source.schema["doc_id"].dataType.simpleString()
    segments = source.mapInArrow(lambda x: _cut(x, length, group), f"anchor bigint, content bigint, doc_id {kind}, first int, passages int")
    again = segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    at = ["anchor", "content", "doc_id", "first"]
    found = stash(segments.join(again, "anchor", "left_semi").groupBy(*at).agg(F.max("passages").alias("passages"), F.count("*").alias("rows")), "segments")
    alike = found.groupBy("anchor", "content").agg(F.sum("rows").cast("int").alias("copies"), F.min(F.struct("doc_id", "first")).alias("lead"), F.max("passages").alias("passages"))
    alike = stash(alike.select("anchor", "content", "copies", "passages", F.col("lead.doc_id").alias("lead_id"), F.col("lead.first").alias("lead_at")), "kinds")
    count = alike.groupBy("anchor").agg(F.count("*").alias("kinds"))
    alike = alike.join(count, "anchor")

    def fetched(which: str) -> DataFrame:
        """The words of one segment of each kind, from the document that has it first."""
        segment = F.struct("anchor", "content", F.col("lead_id").alias("doc_id"), F.col("lead_at").alias("first"), "passages", "copies")
        wanted = alike.where(which).groupBy(F.col("lead_id").alias("doc_id")).agg(F.collect_list(segment).alias("wanted"))
        return source.join(wanted, "doc_id").select("text", "wanted").mapInArrow(lambda x: _fetch(x, length), f"anchor bigint, content bigint, doc_id {kind}, first int, copies int, body array<bigint>")

    sorted_ = fetched(f"kinds BETWEEN 2 AND {kinds}").repartition("anchor").sortWithinPartitions("anchor")
    runs = sorted_.mapInArrow(lambda x: _expand(x, length), "anchor bigint, content bigint, a int, b int, lead boolean")
    crowded = f"kinds > {max(kinds, 1)}"
    if not count.where(crowded).isEmpty():
        each = fetched(crowded).mapInArrow(lambda x: _windows(x, length), f"anchor bigint, content bigint, doc_id {kind}, first int, copies int, a int, passage bigint")
        # Repeated doc_ids can fetch one segment twice.
        each = stash(each.dropDuplicates(["anchor", "content", "a"]), "passages")
        same = each.groupBy("anchor", "passage").agg(F.sum("copies").alias("total"), F.min(F.struct("doc_id", F.col("first") + F.col("a"))).alias("lead")).where("total > 1")
        each = each.join(same, ["anchor", "passage"]).withColumn("lead", F.col("lead") == F.struct("doc_id", F.col("first") + F.col("a")))
        runs = runs.unionByName(each.select("anchor", "content", "a", (F.col("a") + 1).alias("b"), "lead"))
    leads = alike.select("anchor", "content", "lead_id", "lead_at")
    whole = alike.where("kinds = 1").select("anchor", "content", F.lit(0).alias("a"), F.col("passages").alias("b"), F.lit(True).alias("lead"), "lead_id", "lead_at")
    runs = runs.join(leads, ["anchor", "content"]).unionByName(whole)
    here = F.col("lead") & (F.col("doc_id") == F.col("lead_id")) & (F.col("first") == F.col("lead_at"))
    # Of rows that repeat, only one is the first.
    firsts = F.when(here & (F.col("rows") > 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(here))
    spans = found.join(runs, ["anchor", "content"]).select("doc_id", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"), F.explode(firsts).alias("is_first"))
    order = Window.partitionBy("doc_id", "is_first").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("before"), 0).otherwise(1)).over(order)
    merged = spans.withColumn("before", before).withColumn("island", island).groupBy("doc_id", "is_first", "island").agg(F.min("a").alias("start_word"), (F.max("b") + F.lit(length - 1)).alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "is_first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(table(sf_dir, "documents")))


def oracle(length: int = LENGTH) -> str:
    """The same rows in DuckDB: all passages as strings, counted."""
    return f"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), passages AS (
  SELECT doc_id, p, md5(array_to_string(w[p + 1:p + {length}], ' ')) AS passage
  FROM (SELECT doc_id, w, unnest(range(len(w) - {length} + 1)) AS p FROM split WHERE len(w) >= {length})
), counted AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY passage) AS n,
         row_number() OVER (PARTITION BY passage ORDER BY doc_id, p) = 1 AS is_first FROM passages
), marked AS (
  SELECT doc_id, p, is_first, p - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY p) AS island FROM counted WHERE n > 1
)
SELECT doc_id, min(p)::INTEGER AS start_word, (max(p) + {length})::INTEGER AS end_word, (max(p) + {length} - min(p))::INTEGER AS n_words, is_first
FROM marked GROUP BY doc_id, is_first, island"""
