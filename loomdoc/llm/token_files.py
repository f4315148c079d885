"""Token ids in binary files: each document compressed by itself with a zstandard dictionary that all share.

Method. The dictionary is trained on the serialized id arrays of sample_docs documents (those with the least hash of their id,
at most sample_chars characters each). Each document's ids are one frame. A shard image is
    MAGIC, dictionary sha256 (32 bytes), number of documents n, ids before the shard in its part (8 bytes each, little-endian),
    n + 1 frame offsets, n ids of documents, n null flags (1 byte each), the frames;
so a short document is reached by two offsets and one frame. Shards are rows of a Parquet dataset in the shared folder
(part, seq, n_ids, image), which any store that Spark reaches can hold; the dictionary lies beside them, found by its hash.

Defined results. Documents are in ascending doc_id order, null ids first; equal ids in order of the text's hash. A null text is
empty: its ids are the end id alone. Other columns are left out. Empty tables give no shards and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.blocks import slabs_of
from loomdoc.llm.encoders import encoder
from loomdoc.session import new_folder, plan_bytes, written

MAGIC = b"LDTOK01\n"
SHARD_BYTES = 4 << 20


def serialize(ids: np.ndarray | list[int], wide: bool) -> bytes:
    return np.asarray(ids, "<u4" if wide else "<u2").tobytes()


def dictionary_of(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few samples to train on give their own bytes as one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def image(sha: bytes, before: int, ids: list[int | None], frames: list[bytes]) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype("<u8")
    numbers = np.array([x or 0 for x in ids], "<i8")
    nulls = bytes(x is None for x in ids)
    return b"".join([MAGIC, sha, len(ids).to_bytes(8, "little"), before.to_bytes(8, "little"), offsets.tobytes(), numbers.tobytes(), nulls, *frames])


class Shard:
    """Documents of a shard image, each reached by itself."""

    def __init__(self, data: bytes, dictionary: bytes, wide: bool) -> None:
        if data[:8] != MAGIC or data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        self.data, self.n, self.before = memoryview(data), int.from_bytes(data[40:48], "little"), int.from_bytes(data[48:56], "little")
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, 56).astype(np.int64)
        at = 56 + 8 * (self.n + 1)
        numbers, nulls = np.frombuffer(data, "<i8", self.n, at), data[at + 8 * self.n : at + 9 * self.n]
        self.doc_ids = [None if z else int(x) for x, z in zip(numbers, nulls, strict=True)]
        self.frames = at + 9 * self.n
        self.reader = zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary))
        self.kind = "<u4" if wide else "<u2"

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = self.offsets[i], self.offsets[i + 1]
        return np.frombuffer(self.reader.decompress(self.data[self.frames + a : self.frames + b]), self.kind)


class TokenFiles:
    """A written dataset: path, dictionary, whether ids take four bytes."""

    def __init__(self, spark: SparkSession, path: str, dictionary: bytes, wide: bool) -> None:
        self.spark, self.path, self.dictionary, self.wide = spark, path, dictionary, wide

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/shards")

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before), n_tokens, ids_crc32, read back from the shards."""
        dictionary, wide = self.dictionary, self.wide
        # one total for each part: as many as partitions wrote, whatever the number of documents
        totals = sorted(self.shards().groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
        bases, at = {}, 0
        for part, n in totals:
            bases[part], at = at, at + n

        def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for part, blob in zip(frame.column("part").to_pylist(), frame.column("image"), strict=True):
                    shard = Shard(blob.as_py(), dictionary, wide)
                    sizes, crcs = np.zeros(shard.n, np.int64), np.zeros(shard.n, np.int64)
                    for i in range(shard.n):
                        ids = shard[i].astype("<u4")
                        sizes[i], crcs[i] = len(ids), zlib.crc32(ids.tobytes())
                    start = bases[part] + shard.before + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start), pa.array(sizes), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.shards().select("part", "image").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, sample_docs: int = 512, sample_chars: int = 1 << 16, dictionary_bytes: int = 1 << 16, level: int = 3) -> TokenFiles:
    """Encode docs (doc_id, text) and write them; vocabulary: a .json or .model file, by path or name."""
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    wide = encoder(vocabulary).size > 1 << 16
    # ids and hashes first: a task sends sample_docs pairs of numbers to the driver, not texts
    marked = plain.where(F.length("text") <= sample_chars).withColumn("h", F.xxhash64("text"))
    chosen = marked.select("doc_id", "h").orderBy(F.xxhash64("doc_id"), "h").limit(sample_docs).distinct().collect()
    picked = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, h long"))
    sample = marked.join(picked, (marked["doc_id"].eqNullSafe(picked["doc_id"])) & (marked["h"] == picked["h"])).groupBy(marked["doc_id"], marked["h"]).agg(F.max("text").alias("text"))
    texts = [r["text"] for r in sample.orderBy(F.xxhash64("doc_id"), "h").select("text").collect()]
    dictionary = dictionary_of([serialize([*x, end_id], wide) for x in encoder(vocabulary).ids(texts)], dictionary_bytes)
    sha = hashlib.sha256(dictionary).digest()

    def encode(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer = encoder(vocabulary), zstandard.ZstdCompressor(level=level, dict_data=as_dictionary(dictionary))
        for frame in batch:
            for a, b in slabs_of(frame.column("text")):
                ids, first = coder.flat(frame.column("text")[a:b], end_id)
                data = memoryview(ids.astype("<u4" if wide else "<u2")).cast("B")
                at = (first * (4 if wide else 2)).tolist()
                frames = [writer.compress(data[x:y]) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([frame.column("doc_id")[a:b], frame.column("tie")[a:b], pa.array(np.diff(first)), pa.array(frames, pa.binary())], ["doc_id", "tie", "n", "frame"])

    def shards(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, total, before = TaskContext.get().partitionId(), 0, 0, 0
        ids, frames, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total - before], pa.int64()), pa.array([image(sha, before, ids, frames)], pa.binary())], ["part", "seq", "n_ids", "image"])

        for frame in batch:
            for d, n, x in zip(frame.column("doc_id").to_pylist(), frame.column("n").to_pylist(), frame.column("frame").to_pylist(), strict=True):
                ids.append(d)
                frames.append(x)
                total, size = total + n, size + len(x)
                if size >= SHARD_BYTES:
                    yield flush()
                    seq, before, ids, frames, size = seq + 1, total, [], [], 0
        if ids:
            yield flush()

    path = path or new_folder(spark, "tokens")
    encoded = written(plain.withColumn("tie", F.xxhash64("text")).mapInArrow(encode, "doc_id long, tie long, n long, frame binary"), "frames")
    parts = max(8, min(1 << 16, plan_bytes(docs) // (8 << 20)))
    placed = encoded.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "n", "frame")
    placed.mapInArrow(shards, "part int, seq int, n_ids long, image binary").write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(sha.hex(), bytearray(dictionary), wide)], "sha256 string, dictionary binary, wide boolean").coalesce(1).write.parquet(f"{path}/dictionary")
    return TokenFiles(spark, path, dictionary, wide)


def open_tokens(spark: SparkSession, path: str) -> TokenFiles:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return TokenFiles(spark, path, bytes(row.dictionary), row.wide)
