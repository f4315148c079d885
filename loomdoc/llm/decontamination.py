"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Method. Items are partitioned by the power of two of their shingle count. An item's sketch is its k least shingle hashes (bottom-k
MinHash); k is set for each partition from its largest size u as 2 * floor((1 - threshold) * u) + 1. A document that holds at least
threshold of an item's shingles misses at most floor((1 - threshold) * n) of them, so at least k minus that many of the sketch are
among the document's shingles: such documents are the candidates, and none is lost, however long the document is. A candidate is
then verified with all of the item's shingles. Items are the stated query set: they come to the driver in blocks of at most
block_bytes of text, and each block is searched in one pass over the documents; with several, one is broadcast at a time.

Defined results. A-Z is lower-cased; words are runs of bytes other than \\x20 and \\x09-\\x0D; shingles are size consecutive words.
Items with fewer words are one shingle of all their words; items without words or with a null id or text match nothing. Null
texts have no shingles. Rows of docs with a null or repeated doc_id are documents of their own; repeated items too. Other columns
are left out. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.blocks import Words, gram_hashes, lean, slabs_of
from loomdoc.session import written

SCHEMA = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of size words."""
    h = words.hashes()
    grams = gram_hashes(h, size)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    whole = words.doc[: len(grams)] == words.doc[size - 1 :]
    return words.doc[: len(grams)][whole], grams[whole]


class Items:
    """A block of items: sketches and all shingles, by the number of words of a shingle."""

    def __init__(self, ids: list[int], texts: list[str], size: int, threshold: float) -> None:
        words = Words(pa.array(texts, pa.string()), lower=True)
        self.ids = np.array(ids, np.int64)
        self.by_size = {}
        width = np.minimum(words.count, size)
        self.total = np.zeros(len(ids), np.int64)
        self.need = np.zeros(len(ids), np.int64)
        allowed = 1 - threshold
        for k in sorted({int(x) for x in width if x}):
            row, grams = shingles(words, k)
            of = width[row] == k
            pairs = np.unique(np.stack([row[of].astype(np.uint64), grams[of]], 1), axis=0)
            row, grams = pairs[:, 0].astype(np.int64), pairs[:, 1]  # by item, then hash
            n = np.bincount(row, minlength=len(ids))
            self.total += n
            upper = 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
            sketch = np.minimum(n, 2 * np.floor(allowed * upper + 1e-9).astype(np.int64) + 1)
            self.need += np.where(n > 0, sketch - np.floor(allowed * n + 1e-9).astype(np.int64), 0)
            first = np.cumsum(n) - n
            place = np.arange(len(row)) - first[row]
            least = place < sketch[row]
            order = np.argsort(grams[least], kind="stable")
            self.by_size[k] = (grams[least][order], row[least][order], grams, first)

    def search(self, texts: pa.Array, threshold: float) -> tuple[np.ndarray, ...]:
        """(row of texts, item, shared shingles) for containment of at least threshold."""
        words = Words(texts, lower=True)
        out = []
        for k, (keys, owner, grams, first) in self.by_size.items():
            row, have = shingles(words, k)
            at = np.searchsorted(keys, have)
            hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == have))
            if not len(hit):
                continue
            seen = np.unique(np.stack([row[hit].astype(np.uint64), have[hit]], 1), axis=0)
            lo, hi = np.searchsorted(keys, seen[:, 1]), np.searchsorted(keys, seen[:, 1], side="right")
            many = hi - lo
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pair = np.stack([np.repeat(seen[:, 0].astype(np.int64), many), owner[np.repeat(lo, many) + step]], 1)
            pair, count = np.unique(pair, axis=0, return_counts=True)
            pair = pair[count >= self.need[pair[:, 1]]]
            begin = np.searchsorted(row, np.arange(len(texts) + 1))
            for r, i in pair:
                mine = grams[first[i] : first[i] + self.total[i]]
                shared = int(np.isin(mine, have[begin[r] : begin[r + 1]]).sum())
                if shared >= threshold * len(mine) - 1e-9:
                    out.append((r, i, shared))
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    plain = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    ids, texts, total = [], [], 0
    for r in plain.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        total += len(r["text"])
        if total >= block_bytes:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, block_bytes: int = 32 << 20, slab: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment for each item (item_id, text) at least threshold in a document (doc_id, text)."""
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def one(shared: Broadcast[Items]) -> DataFrame:
        def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for frame in frames:
                for a, b in slabs_of(frame.column(1), slab):
                    row, item, n = block.search(frame.column(1)[a:b], threshold)
                    total = block.total[item]
                    yield pa.RecordBatch.from_arrays([frame.column(0)[a:b].take(pa.array(row)), pa.array(block.ids[item]), pa.array(n), pa.array(total), pa.array(n / np.maximum(total, 1))], ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

        return plain.mapInArrow(lean(search), SCHEMA)

    found, left = [], _blocks(items, block_bytes)
    block = next(left, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(Items(*block, size, threshold))  # of at most block_bytes of text
        block = next(left, None)
        if block is None and not found:
            return one(shared)
        found.append(written(one(shared), "found"))
        shared.destroy()  # before the next block is sent
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], SCHEMA)


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, whose doc_id holds no item; rows with a null doc_id stay unless null ids hold one."""
    found = contained_items(docs, items, size, threshold).select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__held"]), "left_anti")
