"""Byte-pair encoding and decoding over a public vocabulary of ranks.

A word is encoded on a contiguous array of its parts and the ranks of neighbouring
pairs: the leftmost lowest rank is found by a scan, the boundary inside that pair is
deleted, and the ranks on either side are looked up anew, until no pair has a rank.
Words of one length go through these steps together, as the rows of a matrix.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import buffers, fresh, list_array, ragged, slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts split into words before merging: the published pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int32(2**31 - 1)
#: Bytes up to which a word is short: its ranks are scanned. A longer one keeps them in a heap.
SHORT = 48
#: Words, and characters of words, that a worker remembers before it starts afresh.
REMEMBERED, REMEMBERED_CHARACTERS = 250_000, 1 << 23


class _Numbered(dict):
    """Numbers for words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_length = np.array([len(t) for t in by_id], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.bits = int(np.ceil(np.log2(len(r) * 6)))
        self.slot_key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << self.bits) + 64, _NONE, np.int32)
        key = (a << 20) | b
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):  # each round, the first of those that want a free slot gets it
            free = self.slot_key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            first = first[free[first]]
            self.slot_key[at[first]], self.slot_rank[at[first]] = key[left[first]], r[left[first]]
            rest = np.setdiff1d(np.arange(len(left)), first)
            taken = self.slot_key[at[rest]] != -1
            left, at = left[rest], at[rest] + taken
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbered()
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.filled = self.characters = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs a, b; _NONE where there is no such token."""
        key = (a.astype(np.int64) << 20) | b
        at = self._slot(key)
        have = self.slot_key[at]
        out = np.where(have == key, self.slot_rank[at], _NONE)
        left = np.flatnonzero((have != key) & (have != -1))
        while len(left):
            at[left] += 1
            have = self.slot_key[at[left]]
            hit = have == key[left]
            out[left[hit]] = self.slot_rank[at[left[hit]]]
            left = left[~hit & (have != -1)]
        return out

    def merge_rows(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Encode byte rows of one length: groups of (row numbers, ids of one length)."""
        done, rows = [], np.arange(len(parts))
        ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
        while len(rows):
            width = parts.shape[1]
            if width == 1:
                done.append((rows, parts))
                break
            every = np.arange(len(rows))
            at = ranks.argmin(1)
            low = ranks[every, at]
            going = low != _NONE
            if not going.all():
                done.append((rows[~going], parts[~going]))
                rows, parts, ranks, at, low = rows[going], parts[going], ranks[going], at[going], low[going]
                every = every[: len(rows)]
            if not len(rows):
                break
            parts[every, at] = low
            columns = np.arange(width)
            parts = parts[columns != (at + 1)[:, None]].reshape(-1, width - 1)
            ranks = ranks[columns[:-1] != at[:, None]].reshape(-1, width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            i, j = at[before], at[after]
            ranks[before, i - 1] = self.rank(parts[before, i - 1], parts[before, i])
            ranks[after, j] = self.rank(parts[after, j], parts[after, j + 1])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word, the ranks in a heap and the parts in a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        texts = [word[i : i + 1] for i in range(n)]
        version = [0] * n
        heap = [(int(r), i, 0, 0) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, vi, vj = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or version[i] != vi or version[j] != vj:
                continue
            ids[i], texts[i] = r, texts[i] + texts[j]
            ids[j] = -1
            version[i] += 1
            version[j] += 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    y = after[x]
                    found = self.ranks.get(texts[x] + texts[y])
                    if found is not None:
                        heapq.heappush(heap, (found, x, version[x], version[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _learn(self, new: list[str], base: int) -> None:
        raw = [w.encode() for w in new]
        self.characters += sum(map(len, new))
        found: list[np.ndarray | None] = [None] * len(new)
        by_length: dict[int, list[int]] = {}
        lengths = np.zeros(len(new), np.int64)
        flat: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(raw):
            whole = self.ranks.get(w)
            if whole is not None:
                found[k] = np.array([whole], np.int32)
            elif len(w) > SHORT:
                found[k] = self.merge_long(w)
            else:
                by_length.setdefault(len(w), []).append(k)
        for n, which in by_length.items():
            rows = self.byte[np.frombuffer(b"".join(raw[k] for k in which), np.uint8)].reshape(-1, n)
            at = np.array(which)
            for r, ids in self.merge_rows(rows):
                lengths[at[r]] = ids.shape[1]
                flat.setdefault(ids.shape[1], []).append((at[r], ids))
        single = [k for k, x in enumerate(found) if x is not None]
        lengths[single] = [len(found[k]) for k in single]
        starts = np.cumsum(lengths) - lengths + self.filled
        total = self.filled + int(lengths.sum())
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < base + len(new):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        for width, groups in flat.items():
            for at, ids in groups:
                self.ids[starts[at][:, None] + np.arange(width)] = ids
        for k in single:
            self.ids[starts[k] : starts[k] + lengths[k]] = found[k]
        self.starts[base : base + len(new)], self.lengths[base : base + len(new)] = starts, lengths
        self.filled = total

    def words(self, texts: list[str]) -> tuple[list[list[str]], list[np.ndarray]]:
        """The words of each text, and their numbers; what is new among them is encoded all at once."""
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self._forget()
        base, number = len(self.known), self.known.__getitem__
        found, numbers = [], []
        for text in texts:
            pieces = self.split(text)
            found.append(pieces)
            numbers.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
        if len(self.known) > base:
            self._learn(list(islice(self.known, base, None)), base)
        return found, numbers

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        _, numbers = self.words(texts)
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        sizes = self.lengths[at]
        ids = self.ids[np.repeat(self.starts[at], sizes) + ragged(sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
        return ids, np.diff(ends[edge])

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        size = self.token_length[ids]
        return self.token_bytes[np.repeat(self.token_start[ids], size) + ragged(size)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; what isn't UTF-8 or no id of the vocabulary becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < self.size)
        if known.all():
            return bytes(self.decode_bytes(ids)).decode("utf-8", "replace")
        cut = np.flatnonzero(~known)
        parts = np.split(ids, np.unique(np.concatenate([cut, cut + 1])))
        return "".join("�" if len(p) == 1 and not 0 <= p[0] < self.size else self.decode(p) for p in parts if len(p))


@lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> Bpe:
    """The vocabulary at path, read once in a process."""
    return Bpe(path)


def _encoded(texts: pa.Array, path: str) -> pa.Array:
    bpe = vocabulary(path)
    ids, counts, same = [], [], []
    data, offsets = buffers(texts)
    for a, b in slices(offsets, 1 << 21):
        part = data[offsets[a] : offsets[b]]
        raw = part.tobytes()
        rows = [raw[i:j].decode() for i, j in zip((offsets[a:b] - offsets[a]).tolist(), (offsets[a + 1 : b + 1] - offsets[a]).tolist(), strict=True)]
        found, n = bpe.encode(rows)
        size = bpe.token_length[found]
        back = bpe.decode_bytes(found)
        edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        if len(back) == len(part) and np.array_equal(edges, offsets[a : b + 1] - offsets[a]):
            wrong = np.concatenate([[0], np.cumsum(back != part)])
            same.append(np.diff(wrong[edges]) == 0)
        else:
            same.append(np.array([bytes(back[i:j]) == r.encode() for i, j, r in zip(edges[:-1], edges[1:], rows, strict=True)], bool))
        ids.append(found)
        counts.append(n)
    null = np.asarray(texts.is_null())
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    columns = [list_array(pa.array(flat, pa.int32()), sizes), pa.array(sizes.astype(np.int32)), pa.array(np.concatenate(same) if same else np.zeros(0, bool))]
    return pa.StructArray.from_arrays(columns, ["token_ids", "n_tokens", "round_trip"], mask=pa.array(null))


def encoded(text: Column, path: str = VOCABULARY) -> Column:
    """struct<token_ids, n_tokens, round_trip> of a text; null for null, no ids for the empty text."""

    @F.arrow_udf("struct<token_ids:array<int>,n_tokens:int,round_trip:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        return _encoded(texts, path)

    return run.asNondeterministic()(text)


def decoded(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of an array of ids; null for null, a null id or one outside the vocabulary becomes U+FFFD."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        bpe = vocabulary(path)
        return pa.array([None if r is None else bpe.decode(np.array([-1 if i is None else i for i in r], np.int64)) for r in rows.to_pylist()], pa.string())

    return run(ids)


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """docs with token_ids, n_tokens and round_trip: whether decoding gives the text back.

    Whole texts are encoded, however long. A null text has nulls, the empty one no ids.
    Repeated rows have the same ids; an empty table stays empty; names that docs has
    already get underscores.
    """
    tmp = fresh(docs, "bpe")
    out = docs.withColumn(tmp, encoded(F.col(text), path))
    for name in ("token_ids", "n_tokens", "round_trip"):
        out = out.withColumn(fresh(docs, name), F.col(f"{tmp}.{name}"))
    return out.drop(tmp)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(table(sf_dir, "documents")).select("doc_id", "text")).drop("text")
