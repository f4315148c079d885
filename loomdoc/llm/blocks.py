"""Documents in bounded groups, and words as flat arrays.

A group holds about GROUP_BYTES of input; the number of groups follows the input, so a group's memory doesn't.
Groups are dealt by a hash of id and text, so no key, source or set of rows with a null id makes a large one.
Facts about documents travel between groups and buckets as packed arrays, a row for each (group, bucket).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.session import plan_bytes

GROUP_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_APART = ~np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def group_count(df: DataFrame, group_bytes: int = GROUP_BYTES, least: int = 32, most: int = 1 << 20) -> int:
    return max(least, min(most, plan_bytes(df) // group_bytes))


def grouped(docs: DataFrame, groups: int, *more: str) -> DataFrame:
    """(g, doc_id, text, *more), dealt by g. Other columns of docs are left out, whatever their names."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    g = F.pmod(F.xxhash64(doc_id, text), F.lit(groups)).cast("int")
    picked = docs.select(g.alias("g"), doc_id.alias("doc_id"), text.alias("text"), *[docs[c].alias(c) for c in more])
    return picked.repartition("g")


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a group in an order that any run repeats, whatever order they arrive in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def ids_of(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table["doc_id"], NO_ID).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0] = 1
        out[1:] = base
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, slab: int = 1 << 17) -> np.ndarray:
    """64 bits for the bytes from start to end, in order of start: a polynomial over keyed bytes, mixed with the length."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(out), slab):
        s, e = start[i : i + slab], end[i : i + slab]
        at = s[0]
        part = _BYTE[data[at : e[-1]]] * _power("up", _BASE, e[-1] - at)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        poly = (total[e - at] - total[s - at]) * _power("down", _UNBASE, e[-1] - at)[s - at]
        out[i : i + slab] = mix(poly + (e - s).astype(np.uint64) * _STEP)
    return out


def slabs_of(column: pa.ChunkedArray | pa.Array, size: int = 2 << 20) -> list[tuple[int, int]]:
    """Rows (from, to) of about so many bytes of a string column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(total // size)) + 1
    return [(int(a), int(b)) for a, b in zip([0, *cut], [*cut, len(column)], strict=True) if b > a]


class Bytes:
    """The UTF-8 bytes of a string column, one after the other; null is empty."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        first = self.offsets[0]
        self.data = np.frombuffer(data, np.uint8)[first : self.offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first
        if lower:
            self.data = _LOWER[self.data]

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(Bytes):
    """Words are the maximal runs of bytes other than \\x20 and \\x09-\\x0D within one text.

    start, end: byte positions; doc: row of each word; first: index of each row's first word, and the end.
    """

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False, letters: bool = False) -> None:
        """letters: words are runs of ASCII letters and bytes from \\x80 on instead."""
        super().__init__(column, lower)
        n = len(self.data)
        solid = ~(_APART if letters else SPACE)[self.data]
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | begins[:n]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | begins[1:])) + 1
        self.start, self.end = start, end
        self.first = np.searchsorted(start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self)), self.count)

    def hashes(self, slab: int = 1 << 17, prefix: int | None = None) -> np.ndarray:
        """64 bits for each word, or for its first prefix bytes."""
        return span_hashes(self.data, self.start, self.end if prefix is None else np.minimum(self.end, self.start + prefix), slab)

    def words(self, row: int) -> list[bytes]:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().split()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries; callers see to it that they belong to one document."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + h[j : j + n]
    return mix(out)


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[0] - 1, 0, 1, .. counts[1] - 1, and so on."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def give_back() -> None:
    """What Arrow and the C library hold free goes back to the system; a worker that is kept for later tasks would hold it on."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow that gives back what it has freed, after each batch and at the end."""

    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield frame
            give_back()

    def over(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(each(frames))
        give_back()

    return over


def as_bytes(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: their number, then dtype, length and bytes of each."""
    parts = [bytes([len(arrays)])]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return b"".join(parts)


def as_arrays(raw: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, lightly compressed."""
    return zstandard.compress(as_bytes(*arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    return as_arrays(zstandard.decompress(blob))


def unpack_all(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of all rows, joined place by place."""
    rows = [unpack(x.as_py()) for x in column]
    return [np.concatenate(x) for x in zip(*rows, strict=True)]


def split_by(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, row numbers in order) for each value of key."""
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.diff(key[order])) + 1
    return [(int(key[x[0]]), x) for x in np.split(order, at) if len(x)]


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))
