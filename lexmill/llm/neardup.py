"""Near-duplicate documents: SimHash fingerprints, all pairs of which within a radius are found.

A fingerprint has BITS bits, each the sign of a sum over the document's distinct words,
weighted by the length in bits of their counts. Two documents are linked whose
fingerprints differ in RADIUS bits at most: all such pairs, none left out.

Fingerprints are cut into radius // (SPARE + 1) + 1 blocks. Two that differ in SPARE + 1
bits or more in each block would differ in more than radius bits, so every pair within
the radius differs in SPARE bits at most in some block, and counts in the first such.

A shard is a block and the value of its first few bits. It holds the fingerprints that
have this value, sorted by their blocks, and is asked by those and by the ones that have
a lesser value but for SPARE bits at most. What asks looks up each greater block value
that its own turns into by as many flips as are left, and is compared with all that have
it. A shard stands with what asks it, so that nothing that grows with the corpus is
broadcast; a crowded shard and what asks it are cut into pieces of bounded size, and each
piece meets all of the other side. Where a radius leaves blocks too few bits to select by,
there is one shard, cut likewise, whose pieces are searched as BK-trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm._text import LOOSE, LOOSE_SQL, buffers, drop_table, fresh, hashes_sql, mix, mix_sql, ragged, slices, stash, table, words

#: Bits of a fingerprint, a multiple of 64; bits in which linked fingerprints may differ, and in which the closest block of a linked pair may.
BITS, RADIUS, SPARE = 128, 20, 2
#: Bits of a block that are looked at, and with fewer of which trees are searched instead; bits of a block that shards may have.
WIDEST, NARROWEST, HIGH = 20, 10, 6
#: Fingerprints that ask with the same block, and pairs of them and of what they ask, from which on all of them are compared at once.
ALIKE, CROWD = 4, 1 << 11
#: Members of a shard's piece, and rows that ask it for each; rows that are sent together; pairs that are compared at once, visits of trees at once, and pairs that are held.
MEMBERS, ASKING, ROWS, VISITS, TREE_VISITS, PAIRS = 1 << 18, 4, 1 << 18, 1 << 16, 1 << 22, 1 << 20
#: Distinct words whose bits are added up at once.
_PART = 1 << 15


def _seed(k: int) -> np.uint64:
    return mix(np.array([k], np.uint64))[0]


def _signatures(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of rows as 64-bit words, and which rows have words."""
    w = words(data, offsets, LOOSE)
    n = len(offsets) - 1
    some = np.diff(w.row) > 0
    out = np.zeros((n, bits // 64), np.uint64)
    if not some.any():
        return out, some
    row = w.rows()
    tagged = w.hash ^ mix(np.arange(n, dtype=np.uint64))[row]
    order = np.argsort(tagged)
    ranked = tagged[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(ranked)))
    which = order[first]
    by = np.argsort(row[which], kind="stable")
    hashes, row = w.hash[which][by], row[which][by]
    weight = np.frexp(count[by].astype(np.float64))[1].astype(np.uint8)
    half = np.bincount(row, weight, n)[:, None] / 2
    for k in range(bits // 64):
        ones = np.zeros((n, 64))
        mixed = mix(hashes ^ _seed(k + 1))
        for a in range(0, len(mixed), _PART):
            part, own = mixed[a : a + _PART], row[a : a + _PART]
            lead = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            each = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1) * weight[a : a + _PART, None]
            ones[own[lead]] += np.add.reduceat(each, lead, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(ones > half, axis=1).view(np.uint64).ravel()
    return out, some


def _binary(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Rows of 64-bit words as binary values; null where mask."""
    size = values.shape[1] * 8
    at = np.arange(len(values) + 1, dtype=np.int32) * size
    valid = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(values), [valid, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _prints(column: pa.Array) -> np.ndarray:
    """The 64-bit words of binary values of one size, none null."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros((0, 1), np.uint64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(np.uint64).reshape(len(column), -1)


def signature(text: Column, bits: int = BITS) -> Column:
    """The fingerprint of a text as bytes; null for null and for a text without words."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        parts = [_signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits) for a, b in slices(offsets)]
        if not parts:
            return pa.array([], pa.binary())
        found, some = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _binary(found, ~some)

    return run.asNondeterministic()(text)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BkForest:
    """BK-trees over distinct fingerprints, one for each number in tree; all are built and searched together.

    The first fingerprint of a tree is its root. The others go to the child at their
    distance, and the first to come to a free edge becomes that child.
    """

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        n, self.wide = len(values), values.shape[1] * 64 + 1
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        left, slot = np.arange(n), np.asarray(tree, np.int64)
        self.root = np.full(int(slot.max()) + 1 if n else 0, -1)
        while len(left):
            order = np.argsort(slot, kind="stable")
            left, slot = left[order], slot[order]
            lead = np.ones(len(left), bool)
            lead[1:] = slot[1:] != slot[:-1]
            if len(left) == n:
                self.root[slot[lead]] = left[lead]
            owner = left[lead][np.cumsum(lead) - 1][~lead]
            left = left[~lead]
            d = _distance(values[left], values[owner])
            parent[left], edge[left] = owner, d
            slot = owner * self.wide + d
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * self.wide + edge[inner]
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], inner[order]

    def search(self, values: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) numbers within radius, each query in the tree named with it, which has members."""
        query, node = np.arange(len(tree)), self.root[tree]
        while len(query):
            d = _distance(values[query], self.values[node])
            near = d <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.key, node * self.wide + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * self.wide + np.minimum(d + radius, self.wide - 1), "right")
            count = high - low
            query, node = np.repeat(query, count), self.child[np.repeat(low, count) + ragged(count)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's connected component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


@dataclass(frozen=True)
class _Plan:
    """How fingerprints are dealt out: blocks as (first bit, bits), bits of the shards, and for crowded shards how many pieces they and what asks them have."""

    radius: int
    blocks: tuple[tuple[int, int], ...]
    high: int = 0
    crowded: dict[int, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, bits: int, radius: int) -> _Plan:
        """Without shards; one block of no bits where blocks would be too narrow."""
        n = radius // (SPARE + 1) + 1
        ends = [bits * k // n for k in range(n + 1)]
        return cls(radius, tuple((a, min(b - a, WIDEST)) for a, b in pairwise(ends)) if bits // n >= NARROWEST else ((0, 0),))

    def dealt(self, counts: np.ndarray, members: int) -> _Plan:
        """With shards and pieces for these counts of fingerprints by block and its first HIGH bits."""
        if not self.blocks[0][1]:
            own = int(counts[0].sum())
            return replace(self, crowded={0: (-(-own // members), -(-own // members))} if own > members else {})
        high = min(max(2, (int(counts[0].sum()) // members).bit_length()), HIGH)
        crowded = {}
        for b, each in enumerate(counts.reshape(len(counts), 1 << high, -1).sum(2)):
            asks = each.copy()
            for flips in _masks(high, SPARE)[1:]:
                lower = np.arange(len(each)) ^ flips
                asks += np.where(lower < np.arange(len(each)), each[lower], 0)
            cut = np.maximum(-(-each // members), 1), np.maximum(-(-asks // (ASKING * members)), 1)
            crowded |= {b << HIGH | c: (t, a) for c, (t, a) in enumerate(zip(*(x.tolist() for x in cut), strict=True)) if t * a > 1 and each[c]}
        return replace(self, high=high, crowded=crowded)


def _masks(width: int, most: int) -> list[int]:
    """Numbers of width bits of which most are set at most, 0 first."""
    return [sum(1 << i for i in x) for k in range(min(most, width) + 1) for x in combinations(range(width), k)]


def _block(values: np.ndarray, first: int, width: int) -> np.ndarray:
    """The bits of fingerprints from the first on as a number."""
    k, shift = divmod(first, 64)
    out = values[:, k] >> np.uint64(shift)
    if shift + width > 64:
        out = out | values[:, k + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], plan: _Plan) -> Iterator[pa.RecordBatch]:
    """(shard, piece, role, fingerprint, n) of fingerprints: role 0 a member that asks too, 1 a member, 2 asking.

    In a crowded shard a member stands in one of its pieces for each piece of what asks,
    and what asks the other way round.
    """
    names = ["shard", "piece", "role", "fingerprint", "n"]
    trees, asking = np.ones(len(plan.blocks) << HIGH, np.int64), np.ones(len(plan.blocks) << HIGH, np.int64)
    for s, cut in plan.crowded.items():
        trees[s], asking[s] = cut
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _prints(batch.column(0))
        hashed = np.zeros(len(values), np.uint64)
        for k in range(values.shape[1]):
            hashed = mix(hashed ^ values[:, k])
        of_tree, of_asks = (hashed >> np.uint64(32)).astype(np.int64), (hashed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for b, (first, width) in enumerate(plan.blocks):
            cell = _block(values, first, width) >> (width - plan.high)
            for flips in _masks(plan.high, SPARE):
                row = np.flatnonzero(cell ^ flips > cell) if flips else np.arange(len(cell))
                shard, role = cell[row] ^ flips | b << HIGH, np.full(len(row), 2 if flips else 0)
                piece = np.zeros(len(row), np.int64)
                cut = trees[shard] * asking[shard] > 1
                if cut.any():
                    asks = np.flatnonzero(cut)
                    member = asks if not flips else asks[:0]
                    t, a = trees[shard], asking[shard]
                    m, q = np.repeat(member, a[member]), np.repeat(asks, t[asks])
                    m_piece = of_tree[row[m]] % t[m] * a[m] + ragged(a[member])
                    q_piece = ragged(t[asks]) * a[q] + of_asks[row[q]] % a[q]
                    piece = np.concatenate([piece[~cut], m_piece, q_piece])
                    role = np.concatenate([role[~cut], np.full(len(m), 1), np.full(len(q), 2)])
                    row, shard = (np.concatenate([x[~cut], x[m], x[q]]) for x in (row, shard))
                for i in range(0, len(row), ROWS):
                    r = row[i : i + ROWS]
                    columns = [pa.array(shard[i : i + ROWS], pa.int32()), pa.array(piece[i : i + ROWS], pa.int32()), pa.array(role[i : i + ROWS], pa.int8()), _binary(values[r]), batch.column(1).take(pa.array(r))]
                    yield pa.RecordBatch.from_arrays(columns, names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, piece, rows) of rows of _shards: those of a shard's piece together as bytes, about ROWS of all at a time, so that few rows are shuffled and sorted."""
    held: list[tuple[np.ndarray, ...]] = []

    def pack() -> pa.RecordBatch:
        shard, piece, role, values, n = (np.concatenate(x) for x in zip(*held, strict=True))
        key = shard.astype(np.int64) << 32 | piece
        order = np.argsort(key, kind="stable")
        lead = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        rows = [values[x].tobytes() + n[x].tobytes() + role[x].tobytes() for x in np.split(order, lead[1:])]
        first = order[lead]
        return pa.RecordBatch.from_arrays([pa.array(shard[first]), pa.array(piece[first]), pa.array(rows, pa.binary())], ["shard", "piece", "rows"])

    for batch in batches:
        if batch.num_rows:
            held.append(_arrays(batch))
        if sum(len(x[0]) for x in held) >= ROWS:
            yield pack()
            held = []
    if held:
        yield pack()


def _unpacked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The rows that _packed packed."""
    for batch in batches:
        for shard, piece, rows in zip(*(batch.column(k) for k in range(3)), strict=True):
            data = np.frombuffer(rows.as_buffer(), np.uint8)
            n = len(data) // (bits // 8 + 9)
            values, counts, role = np.split(data, [n * bits // 8, n * (bits // 8 + 8)])
            columns = [pa.array(np.full(n, shard.as_py(), np.int32)), pa.array(np.full(n, piece.as_py(), np.int32)), pa.array(role.view(np.int8)), _binary(values.copy().view(np.uint64).reshape(n, -1)), pa.array(counts.copy().view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "piece", "role", "fingerprint", "n"])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The columns of rows of _shards."""
    return (*(np.asarray(batch.column(k)) for k in range(3)), _prints(batch.column(3)), np.asarray(batch.column(4)))


def _near(shard: int, role: np.ndarray, values: np.ndarray, plan: _Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking, member) rows of a piece of a shard that are within the radius, each pair of the shard once."""
    inside, asks = np.flatnonzero(role < 2), np.flatnonzero(role != 1)
    if not len(inside) or not len(asks):
        return
    first, width = plan.blocks[shard >> HIGH]
    if not width:
        forest = BkForest(values[inside], np.zeros(len(inside), np.int64))
        step = max(1, TREE_VISITS // len(inside))
        for i in range(0, len(asks), step):
            some = asks[i : i + step]
            for q, m in forest.search(values[some], np.zeros(len(some), np.int64), plan.radius):
                above = _above(values[inside[m]], values[some[q]])
                yield some[q[above]], inside[m[above]]
        return
    low = width - plan.high
    block = _block(values, first, width)
    cell, inner = block >> low, block & ((1 << low) - 1)
    inside, asks = inside[np.argsort(inner[inside], kind="stable")], asks[np.argsort(block[asks], kind="stable")]
    start = np.zeros((1 << low) + 1, np.int64)
    np.cumsum(np.bincount(inner[inside], minlength=1 << low), out=start[1:])
    # Bits outside the block come first, since those in it hardly differ.
    words = sorted(range(values.shape[1]), key=lambda k: k == (first + width // 2) // 64)
    of_all = [np.ascontiguousarray(values[:, k]) for k in words]
    of_inside = [x[inside] for x in of_all]
    lead = np.flatnonzero(np.concatenate([[True], cell[asks[1:]] != cell[asks[:-1]]]))
    for i, j in zip(lead, [*lead[1:], len(asks)], strict=True):
        flips = int(cell[asks[i]]) ^ (shard & ((1 << HIGH) - 1))
        masks = np.array(_masks(low, SPARE - flips.bit_count()))
        # What asks with the same block is compared with the same members: all of it at once where that pays.
        own = inner[asks[i:j]]
        alike = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        kind, many = own[alike], np.diff(np.append(alike, j - i))
        each = np.zeros(len(kind), np.int64)
        for mask in masks.tolist():
            at = kind ^ mask
            each += np.where((at >= kind) | (flips > 0), start[at + 1] - start[at], 0)
        crowd = (many >= ALIKE) & (many * each >= CROWD)
        for g in np.flatnonzero(crowd).tolist():
            at = kind[g] ^ masks
            begin = start[at]
            count = np.where((at >= kind[g]) | (flips > 0), start[at + 1] - begin, 0)
            m = np.repeat(begin - np.cumsum(count) + count, count)
            m += np.arange(len(m))
            q = asks[i + alike[g] : i + alike[g] + many[g]]
            for asked, found in _square([x[q] for x in of_all], [x[m] for x in of_inside], plan.radius):
                asked, found = q[asked], inside[m[found]]
                if not flips:
                    keep = np.flatnonzero((inner[found] > kind[g]) | _above(values[found], values[asked]))
                    asked, found = asked[keep], found[keep]
                yield asked, found
        rest = asks[i:j][~np.repeat(crowd, many)]
        for mask in masks.tolist():
            q = rest
            at = inner[q] ^ mask
            if mask and not flips:
                q, at = (x[at > inner[q]] for x in (q, at))
            begin = start[at]
            count = start[at + 1] - begin
            some = count > 0
            q, begin, count = q[some], begin[some], count[some]
            until = np.cumsum(count)
            x = 0
            while x < len(q):
                base = until[x - 1] if x else 0
                y = max(x + 1, int(np.searchsorted(until, base + VISITS, "right")))
                n = count[x:y]
                m = np.repeat(begin[x:y] - (until[x:y] - n - base), n)
                m += np.arange(len(m))
                asked = np.repeat(q[x:y], n)
                d = np.bitwise_count(np.repeat(of_all[0][q[x:y]], n) ^ of_inside[0][m]).astype(np.int16)
                for k in range(1, len(words)):
                    keep = np.flatnonzero(d <= plan.radius)
                    m, asked = m[keep], asked[keep]
                    d = d[keep] + np.bitwise_count(of_all[k][asked] ^ of_inside[k][m])
                keep = d <= plan.radius
                asked, m = asked[keep], inside[m[keep]]
                if not mask and not flips:
                    keep = _above(values[m], values[asked])
                    asked, m = asked[keep], m[keep]
                yield asked, m
                x = y


def _square(a: list[np.ndarray], b: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number in a, number in b) of all pairs within the radius; a and b are fingerprints by 64-bit words, every one of a against every one of b."""
    wide = max(1, min(len(b[0]), VISITS // ALIKE))
    high = min(len(a[0]), VISITS // wide)
    # All words are compared before any pair is picked, in place: about a sixth of the pairs are near by one word alone.
    bits, one = np.empty(high * wide, np.uint64), np.empty(high * wide, np.uint8)
    sums = np.empty(high * wide, np.uint8 if len(a) < 4 else np.uint16)
    for y in range(0, len(b[0]), wide):
        right = [x[y : y + wide] for x in b]
        for x in range(0, len(a[0]), high):
            shape = len(a[0][x : x + high]), len(right[0])
            apart, d, each = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in (bits, sums, one))
            for k, (left, other) in enumerate(zip(a, right, strict=True)):
                np.bitwise_xor(left[x : x + high, None], other, out=apart)
                np.bitwise_count(apart, out=each if k else d)
                if k:
                    np.add(d, each, out=d)
            at = np.flatnonzero(d <= radius)
            if len(at):
                i = at // shape[1]
                yield x + i, y + at - i * shape[1]


def _joined(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, VISITS or more at a time but for the last."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for pair in pairs:
        if len(pair[0]):
            held.append(pair)
            count += len(pair[0])
        if count >= VISITS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _found(shard: int, role: np.ndarray, values: np.ndarray, copies: np.ndarray, plan: _Plan) -> pa.RecordBatch | None:
    """(fingerprint, root, links) of what is linked in a piece of a shard: one that is linked with it, maybe through others, and copies of those linked.

    A pair counts in its first close block, and only there.
    """
    n = len(role)
    root, links = np.arange(n), np.zeros(n, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def merged() -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip((np.arange(n), root), *held, strict=True))
        return _roots(n, a, b)

    for q, m in _joined(_near(shard, role, values, plan)):
        if len(q):
            apart = values[q] ^ values[m]
            new = np.ones(len(q), bool)
            for first, width in plan.blocks[: shard >> HIGH]:
                new &= np.bitwise_count(_block(apart, first, width)) > SPARE
            q, m = q[new], m[new]
            np.add.at(links, q, copies[m])
            np.add.at(links, m, copies[q])
            new = root[q] != root[m]
            held.append((q[new], m[new]))
            count += int(new.sum())
            if count > PAIRS:
                root, held, count = merged(), [], 0
    if held:
        root = merged()
    some = np.flatnonzero(links)
    if not len(some):
        return None
    return pa.RecordBatch.from_arrays([_binary(values[some]), _binary(values[root[some]]), pa.array(links[some])], ["fingerprint", "root", "links"])


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bytes of a come after those of b."""
    a, b = a.byteswap(), b.byteswap()
    out, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
    for k in range(a.shape[1]):
        out |= open_ & (a[:, k] > b[:, k])
        open_ &= a[:, k] == b[:, k]
    return out


def _link(batches: Iterator[pa.RecordBatch], plan: _Plan) -> Iterator[pa.RecordBatch]:
    """What _found gives for rows of _shards sorted by shard and piece, a piece at a time."""
    held: list[tuple[np.ndarray, ...]] = []

    def solve() -> Iterator[pa.RecordBatch]:
        if held:
            shard, _, *rows = (np.concatenate(x) for x in zip(*held, strict=True))
            out = _found(int(shard[0]), *rows, plan)
            if out is not None:
                yield out

    for batch in batches:
        rows = _arrays(batch)
        ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        for a, b in pairwise([0, *ends.tolist(), batch.num_rows]):
            if a == b:
                continue
            if held and (held[-1][0][-1] != rows[0][a] or held[-1][1][-1] != rows[1][a]):
                yield from solve()
                held = []
            held.append(tuple(x[a:b] for x in rows))
    yield from solve()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that isn't its component's least.

    Alternates large-star and small-star steps (Kiveris and others, 2014), each written
    as a table that replaces the one before, until a round leaves the edges as they were.
    Least neighbours are aggregated before they are shuffled and then joined, so that a
    node of very many edges needs no task of its own.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = stash(e, "edges"), None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        steps = least.select("a", F.col("m").alias("b")).unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now_e = stash(steps.where("a <> b").distinct(), "edges")
        drop_table(e)
        e = now_e


def _counts(prints: DataFrame, plan: _Plan) -> np.ndarray:
    """How many fingerprints there are by block and its first HIGH bits."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _prints(batch.column(0))
            shards = np.concatenate([_block(values, first, width) >> max(width - HIGH, 0) | b << HIGH for b, (first, width) in enumerate(plan.blocks)])
            kinds, n = np.unique(shards, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(n, pa.int64())], ["shard", "n"])

    rows = prints.select("fingerprint").mapInArrow(own, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(plan.blocks) << HIGH, np.int64)
    out[np.asarray(rows["shard"])] = np.asarray(rows["n"])
    return out.reshape(len(plan.blocks), -1)


def groups(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id", bits: int = BITS, members: int = MEMBERS) -> DataFrame:
    """(doc_id, fingerprint, group_id, group_size, n_links) of the rows of docs that have words.

    Rows are linked whose fingerprints differ in radius bits at most, and what is linked through others
    is one group; group_id is its least doc_id, and n_links counts the rows with which a
    row is linked itself, those of the same fingerprint among them. Rows with a null
    doc_id, a null text or a text without words are in no group and have no row here; an
    empty table gives none. Repeated rows count each. Whole texts are read, however long;
    other columns aren't. bits is a multiple of 64, and members what a shard's piece holds.
    """
    signed = docs.select(F.col(key).alias("doc_id"), signature(F.col(text), bits).alias("fingerprint"))
    signed = stash(signed.where("doc_id IS NOT NULL AND fingerprint IS NOT NULL"), "signatures")
    prints = stash(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    plan = _Plan.of(bits, radius)
    plan = plan.dealt(_counts(prints, plan), members)
    rows = prints.select("fingerprint", "n").mapInArrow(lambda x: _packed(_shards(x, plan)), "shard int, piece int, rows binary")
    # A number of partitions of its own, since few rows can be much work.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "shard", "piece").sortWithinPartitions("shard", "piece")
    linked = stash(rows.mapInArrow(lambda x: _link(_unpacked(x, bits), plan), "fingerprint binary, root binary, links bigint"), "links")
    roots = components(linked.select(F.col("fingerprint").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("fingerprint").agg(F.sum("links").alias("links"))
    labels = prints.join(links, "fingerprint", "left").join(roots, F.col("fingerprint") == F.col("node"), "left")
    labels = labels.select("fingerprint", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "fingerprint").alias("root"))
    whole = labels.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_size"))
    labels = labels.join(whole, "root").select("fingerprint", "group_id", "group_size", (F.col("links") + F.col("n") - 1).alias("n_links"))
    return signed.join(labels, "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size", "n_links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(doc_id, group_id, group_size, n_links, keep) of the documents that have near duplicates; see groups.

    keep is true for the member whose doc_id is the group's least. Members with equal
    doc_ids, as repeated rows have, share it.
    """
    some = groups(docs, radius, text, key, bits).where("group_size > 1")
    return some.select("doc_id", "group_id", "group_size", "n_links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def deduplicate(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """docs with one row of each group of near duplicates; see groups.

    Rows in no group stay: those with a null doc_id, a null text or no words. Of repeated
    rows one stays; an empty table stays empty.
    """
    found = stash(groups(docs, radius, text, key, bits), "groups")
    lost_id, lost_print, again_id, tmp, n = (fresh(docs, c) for c in ("lost_id", "lost_fingerprint", "again_id", "fingerprint", "number"))
    lost = found.where("doc_id <> group_id").select(F.col("doc_id").alias(lost_id), F.col("fingerprint").alias(lost_print)).distinct()
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(again_id))
    again = stash(again, "repeated")
    # Shuffled at every size, and without sorting texts: what is lost grows with the corpus.
    lost = lost.hint("shuffle_hash")
    if again.isEmpty():
        return docs.join(lost, F.col(key) == F.col(lost_id), "left_anti")
    # Rows that share a doc_id are told apart by their fingerprints, and equal ones numbered.
    single = docs.join(again, F.col(key) == F.col(again_id), "left_anti")
    out = single.join(lost, F.col(key) == F.col(lost_id), "left_anti")
    many = docs.join(again, F.col(key) == F.col(again_id), "left_semi").withColumn(tmp, signature(F.col(text), bits))
    many = many.join(lost, (F.col(key) == F.col(lost_id)) & (F.col(tmp) == F.col(lost_print)), "left_anti")
    # The number is held against 1 alone, which lets tasks drop the others before the shuffle.
    firsts = many.where(F.col(tmp).isNotNull()).withColumn(n, F.row_number().over(Window.partitionBy(key, tmp).orderBy(key))).where(F.col(n) == 1)
    return out.unionByName(firsts.drop(tmp, n)).unionByName(many.where(F.col(tmp).isNull()).drop(tmp))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(table(sf_dir, "documents")))


def oracle(radius: int = RADIUS) -> str:
    """The same rows in DuckDB: all pairs of fingerprints, and everything that can be reached from each."""
    half = BITS // 128 * 64
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, row_number() OVER () AS r, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), counted AS (
  SELECT r, w, length(bin(count(*))) AS weight FROM (SELECT r, unnest({LOOSE_SQL.format("text")}) AS w FROM rows) GROUP BY 1, 2
), {hashes_sql("SELECT w FROM counted")}, two AS (
  SELECT w, {mix_sql(f"xor(h, {_seed(1)}::UBIGINT)")} AS h1, {mix_sql(f"xor(h, {_seed(2)}::UBIGINT)")} AS h2 FROM hashed
), bits AS (
  SELECT r, b, 2 * sum(CASE WHEN (h1 >> b) & 1 = 1 THEN weight ELSE 0 END) > sum(weight) AS one1, 2 * sum(CASE WHEN (h2 >> b) & 1 = 1 THEN weight ELSE 0 END) > sum(weight) AS one2
  FROM (SELECT r, w, weight, unnest(range({half})) AS b FROM counted) JOIN two USING (w) GROUP BY r, b
), signed AS (
  SELECT r, sum(CASE WHEN one1 THEN 1::HUGEINT << b ELSE 0 END)::UBIGINT AS p1, sum(CASE WHEN one2 THEN 1::HUGEINT << b ELSE 0 END)::UBIGINT AS p2 FROM bits GROUP BY r
), prints AS (
  SELECT p1, p2, row_number() OVER (ORDER BY p1, p2) AS k, count(*) AS n, min(doc_id) AS least FROM signed JOIN rows USING (r) GROUP BY p1, p2
), pairs AS (
  SELECT a.k AS a, b.k AS b, b.n AS n, xor(a.p1, b.p1) AS x1, xor(a.p2, b.p2) AS x2 FROM prints a JOIN prints b ON a.k <> b.k
), linked AS (
  SELECT a, b, n FROM pairs WHERE bit_count(x1::HUGEINT) + bit_count(x2::HUGEINT) <= {radius}
), reach(a, b) AS (
  SELECT k, k FROM prints UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
), grouped AS (
  SELECT a AS k, min(least) AS group_id, sum(n)::BIGINT AS group_size FROM reach JOIN prints ON reach.b = prints.k GROUP BY a
), degree AS (
  SELECT a AS k, sum(n) AS links FROM linked GROUP BY a
)
SELECT doc_id, group_id, group_size, (coalesce(links, 0) + n - 1)::BIGINT AS n_links, doc_id = group_id AS keep
FROM rows JOIN signed USING (r) JOIN prints USING (p1, p2) JOIN grouped USING (k) LEFT JOIN degree USING (k) WHERE group_size > 1"""
