"""Vectorised views of Arrow string columns: bytes, words, rolling hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = b" \t\n\r\f\v"

#: Bytes a slice of documents holds, so that eight-byte arrays over it stay in cache.
SLICE = 1 << 20


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thinned(df: DataFrame, rows: int, bound: int, hashed: Column) -> DataFrame:
    """Rows of df whose hashes are in a range that leaves about twice bound of them; all where there are no more."""
    share = min(1.0, 2 * bound / max(rows, 1))
    return df if share == 1 else df.where(F.pmod(hashed, F.lit(1 << 40)) < int(share * (1 << 40)))


_scratch: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_scratch() -> None:
    for path, spark in _scratch.items():
        with contextlib.suppress(Exception):
            if path.startswith("file:") or "://" not in path:
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            else:
                _remove(spark, path)


def _shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: tables between stages are written there")
    root = next((p for p in _scratch if p.startswith(f"{tempfile.gettempdir()}/lexmill-") and p.count("/") == 2), None) or tempfile.mkdtemp(prefix="lexmill-")
    _scratch[root] = spark
    return root


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the folder that all executors share, and read again.

    The folder is the session's spark.checkpoint.dir. Where that is unset, as in tests, a
    session in one process uses a temporary folder, and any other an error. Tables go when
    the process ends, or with drop_table.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that stash wrote and nothing reads any more."""
    files = df.inputFiles()
    path = next((p for p in _scratch if files and f"/{p.rsplit('/', 1)[-1]}/" in files[0]), None)
    if path:
        _remove(_scratch.pop(path), path)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit over all others."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_tables: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(kind: str, n: int) -> np.ndarray:
    """base ** i (up) or base ** -i (down), modulo 2**64, for i below n."""
    have = _tables[kind]
    while len(have) < n:
        step = pow(_BASE if kind == "up" else _INVERSE, len(have), 1 << 64)
        have = np.concatenate([have, have * U64(step)])
    _tables[kind] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base ** i; see span_hash."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64, copy=False) * powers("up", len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of values[start:end], equal for equal runs wherever they lie."""
    return mix((sums[end] - sums[start]) * powers("down", len(sums))[start])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lut(separators: bytes = _SPACE, lower: bool = False) -> np.ndarray:
    """A byte map: 0 for separators, else the byte, ASCII letters in lower case if asked."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = 1
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


#: Words between ASCII white space, as they stand.
EXACT = lut()
#: Words of ASCII letters, digits and non-ASCII bytes, in lower case.
LOOSE = lut(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


class Words:
    """Words of documents: hash per word, byte positions, and rows as ranges of words."""

    __slots__ = ("end", "hash", "row", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, by: np.ndarray, hashed: bool = True):
        body = by[data]
        inside = body != 0
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        edge[first] = inside[first]
        self.start = np.flatnonzero(edge)
        edge = inside
        last = inside.copy()
        last[:-1] &= ~edge[1:]
        final = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[final] = edge[final]
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.start, offsets)
        self.hash = span_hash(prefix(body), self.start, self.end) if hashed else None

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


def cuts(data: np.ndarray, by: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about limit bytes of one document that end after a separator of by, or at its end."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        if hi < len(data):
            gaps = np.flatnonzero(by[data[lo:hi]] == 0)
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                while hi < len(data):
                    rest = np.flatnonzero(by[data[hi : hi + limit]] == 0)
                    if len(rest):
                        hi += int(rest[0]) + 1
                        break
                    hi = min(hi + limit, len(data))
        yield lo, hi
        lo = hi


def parted(make: Callable[[np.ndarray, np.ndarray], Words], data: np.ndarray, offsets: np.ndarray, by: np.ndarray, limit: int) -> Words:
    """make's words of documents; those of one document beyond limit bytes are found in parts cut at separators."""
    if len(data) <= limit or len(offsets) != 2:
        return make(data, offsets)
    parts = []
    for lo, hi in cuts(data, by, limit):
        part = make(data[lo:hi], np.array([0, hi - lo]))
        part.start, part.end = part.start + lo, part.end + lo
        parts.append(part)
    out = parts[0]
    out.start, out.end, out.hash = (np.concatenate([getattr(p, k) for p in parts]) for k in ("start", "end", "hash"))
    out.row = np.array([0, len(out.start)])
    return out


def words(data: np.ndarray, offsets: np.ndarray, by: np.ndarray = EXACT, limit: int = 1 << 22) -> Words:
    """Words of documents. One document beyond limit bytes is hashed in parts cut between words."""
    return parted(lambda d, o: Words(d, o, by), data, offsets, by, limit)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for each i at which the window fits."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n]) if have < width else out[:n]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


#: DuckDB: the LOOSE words of a text, and a word in lower case.
LOOSE_SQL = "list_transform(regexp_extract_all({}, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def mix_sql(x: str) -> str:
    """DuckDB: mix of an UBIGINT."""
    times = lambda v, c: f"(({v})::UHUGEINT * {c}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    x = times(f"xor({x}, {x} >> 30)", 0xBF58476D1CE4E5B9)
    return f"list_transform([{x}], lambda a: list_transform([{times('xor(a, a >> 27)', 0x94D049BB133111EB)}], lambda b: xor(b, b >> 31))[1])[1]"


def hashes_sql(source: str) -> str:
    """DuckDB, within WITH RECURSIVE: hashed (w, h), the hashes of the words w of source."""
    whole = "18446744073709551616"
    byte = "(strpos('0123456789ABCDEF', h[2 * j + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * j + 2]) - 1"
    return f"""vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM ({source}))
), powers(j, p) AS (
  SELECT 0, 1::UHUGEINT UNION ALL SELECT j + 1, p * {_BASE}::UHUGEINT % {whole}::UHUGEINT FROM powers WHERE j < (SELECT max(length(h)) FROM vocabulary) // 2
), summed AS (
  SELECT w, (sum(({byte})::HUGEINT * p::HUGEINT) % {whole}::HUGEINT)::UBIGINT AS s FROM (SELECT w, unnest(range(length(h) // 2)) AS j, h FROM vocabulary) JOIN powers USING (j) GROUP BY w
), hashed AS (
  SELECT w, {mix_sql("s")} AS h FROM summed
)"""
