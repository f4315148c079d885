"""Packing: shortest pack first over the histogram of piece lengths, then documents join the patterns by rank.

Method. A document's ids (with the end id) are cut every size ids; a piece is a whole cut or what remains. Only the histogram of
lengths (at most size entries) reaches the driver. Lengths are placed longest first, each into the shortest pack that has room,
for all pieces and packs of a kind at once, so packs are pattern counts. Where more than most_padding of all sequences would be
left open, as with one hot length just over half the size, the emptiest packs are dissolved and their pieces cut to fill the holes
of the others, on counts too; documents with such a piece are encoded once more for the crc of its parts. Every piece has a rank
among those of its length; ranks are laid over the patterns' slots in order.

Defined results. A null text is empty: its ids are the end id. Repeated rows and null ids are documents of their own. Other
columns are left out. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdoc.llm.blocks import lean, slabs_of, spans
from loomdoc.llm.encoders import encoder
from loomdoc.session import file_count, plan_bytes, written

PIECE = "doc_id long, tie long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack in order of placement, number of such packs) for a histogram length -> number of pieces."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by length so far
    for length in sorted((x for x in histogram if x), reverse=True):
        left = histogram[length]
        for used in range(length, size - length + 1):  # packs hold pieces no shorter than this one
            while left and open_packs.get(used):
                pattern, have = open_packs[used].popitem()
                taken = min(left, have)
                if have > taken:
                    open_packs[used][pattern] = have - taken
                grown = (*pattern, length)
                open_packs[used + length][grown] = open_packs[used + length].get(grown, 0) + taken
                left -= taken
            if not left:
                break
        # no open pack has room: new ones, each taking as many as fit
        fits = size // length
        for many, packs in ((fits, left // fits), (left % fits, 1)):
            if many and packs:
                pattern = (length,) * many
                open_packs[length * many][pattern] = open_packs[length * many].get(pattern, 0) + packs
    return sorted((p, n) for used in open_packs.values() for p, n in used.items())


def refilled(packs: list[tuple[tuple[int, ...], int]], size: int, least: int = 32) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], dict[int, list[tuple[int, list[tuple[int, int, int]]]]]]:
    """The packs with the emptiest of them dissolved, and their pieces cut to fill the holes of at least least ids in the others.

    Returns (slots (key, length) of a pack, number of such packs), where key is -length for a whole piece; and by length the plans of
    its cut pieces: how many are cut so, and for each part (key, rank of the first among the key's slots, length). All on counts.
    """
    packs = sorted(packs, key=lambda x: (sum(x[0]), x[0]))
    room, moving, i, taken = sum((size - sum(p)) * n for p, n in packs if size - sum(p) >= least), defaultdict(int), 0, 0
    while i < len(packs):
        pattern, n = packs[i]
        used, free = sum(pattern), size - sum(pattern)
        held = free if free >= least else 0
        few = max(0, min(n, (room - taken) // max(1, used + held)))  # each pack that goes takes its own hole with it
        for length in pattern:
            moving[length] += few
        room, taken = room - few * held, taken + few * used
        packs[i] = (pattern, n - few)
        if few < n:
            break
        i += 1
    done, holes = [], []
    for pattern, n in packs:
        slots, free = tuple((-x, x) for x in pattern), size - sum(pattern)
        if n and free >= least:
            heapq.heappush(holes, (-free, slots, n))
        elif n:
            done.append((slots, n))
    plans, key = defaultdict(list), 0
    for length in sorted((x for x, n in moving.items() if n), reverse=True):
        work = [(moving[length], length, [])]
        while work:
            count, rest, parts = work.pop()
            free, slots, n = heapq.heappop(holes) if holes else (-size, (), count)
            put, some = min(rest, -free), min(count, n)
            whole = put == length
            slot, key = (-length if whole else key, put), key + (not whole)
            if n > some and slots:
                heapq.heappush(holes, (free, slots, n - some))
            if -free - put >= least:
                heapq.heappush(holes, (free + put, (*slots, slot), some))
            else:
                done.append(((*slots, slot), some))
            if count > some:
                work.append((count - some, rest, [(k, first + some, m) for k, first, m in parts]))
            parts = [*parts, (slot[0], 0, put)]
            if rest > put:
                work.append((some, rest - put, parts))
            elif not whole:
                plans[length].append((some, parts))
    return sorted(done + [(slots, n) for _, slots, n in holes]), plans


def _layout(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, list[tuple[int, int, list[int]]]]:
    """For each key, rows (first rank, first sequence, places of the key's slots in the pattern)."""
    used, sequence = defaultdict(int), 0
    rows = defaultdict(list)
    for pattern, many in patterns:
        places = defaultdict(list)
        at = 0
        for key, length in pattern:
            places[key].append(at)
            at += length
        for key, slots in places.items():
            rows[key].append((used[key], sequence, slots))
            used[key] += many * len(slots)
        sequence += many
    return rows


def pieces_of(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for frame in frames:
            for a, b in slabs_of(frame.column(1)):
                ids, first = coder.flat(frame.column(1)[a:b], end_id)
                total = np.diff(first)
                pieces = -(-total // size)
                row, start = np.repeat(np.arange(b - a), pieces), spans(pieces) * size
                length = np.minimum(size, total[row] - start)
                at, data = first[row] + start, memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                rows = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([frame.column(0).take(rows), frame.column(2).take(rows), *[pa.array(x, pa.int64()) for x in (start, length, crc, total[row])]], ["doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens"])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.withColumn("tie", F.xxhash64("text")).mapInArrow(lean(cut), PIECE)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, most_padding: float = 0.01) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs (doc_id, text).

    vocabulary: a .json or .model file, by path or name. start, offset, length: in ids, of the document and of the sequence.
    """
    pieces = written(pieces_of(docs, vocabulary, size, end_id), "pieces", files=file_count(docs))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    packs, plans = shortest_pack_first(histogram, size), {}
    patterns = [(tuple((-x, x) for x in p), n) for p, n in packs]
    if sum((size - sum(p)) * n for p, n in packs) > most_padding * size * sum(n for _, n in packs):
        patterns, plans = refilled(packs, size)
    rows = _layout(patterns)
    # rank within a length: lengths are dealt over chunks, so that a length which most pieces have is nobody's alone
    chunks = max(16, min(1 << 16, plan_bytes(docs) // (4 << 20)))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie", "start"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "tie", "start", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(starts, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("within") - 1)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {key: np.array([r[0] for r in got]) for key, got in rows.items()}
        whole = {n: many - sum(k for k, _ in plans.get(n, ())) for n, many in histogram.items()}
        cuts = {n: whole[n] + np.cumsum([0, *[k for k, _ in found]]) for n, found in plans.items()}

        def find(key: int, rank: int) -> tuple[int, int]:
            first, base, slots = rows[key][int(np.searchsorted(firsts[key], rank, side="right")) - 1]
            return base + (rank - first) // len(slots), slots[(rank - first) % len(slots)]

        for frame in frames:
            of, start, length, sequence, offset, cut = [], [], [], [], [], []
            for i, (n, r, at) in enumerate(zip(*(frame.column(x).to_pylist() for x in ("length", "rank", "start")), strict=True)):
                parts = [(-n, r, n)]
                if r >= whole[n]:
                    j = int(np.searchsorted(cuts[n], r, side="right")) - 1
                    parts = [(key, first + r - int(cuts[n][j]), m) for key, first, m in plans[n][j][1]]
                for key, rank, m in parts:
                    found = find(key, rank)
                    of.append(i)
                    start.append(at)
                    length.append(m)
                    sequence.append(found[0])
                    offset.append(found[1])
                    cut.append(len(parts) > 1)
                    at += m
            kept = frame.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("tie"), pa.array(start, pa.int64()), pa.array(length, pa.int64()), kept.column("ids_crc32"), kept.column("doc_tokens"), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(cut, pa.bool_())], names)

    out = "doc_id long, tie long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean"
    names = [x.split()[0] for x in out.split(", ")]
    placed = ranked.select("doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, out)
    if not plans:
        return placed.drop("tie", "cut")
    placed = written(placed, "placed", files=file_count(docs))
    return placed.where("not cut").drop("tie", "cut").unionByName(_cut_pieces(docs, placed.where("cut"), vocabulary, end_id))


def _cut_pieces(docs: DataFrame, cuts: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The parts of cut pieces, with the crc of their own ids: only documents that have one are encoded again."""
    parts = cuts.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "length", "doc_tokens", "sequence_id", "offset")).alias("parts"))  # of one remainder, of each copy of a row
    texts = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].cast("string").alias("text")).withColumn("__tie", F.xxhash64("text")).dropDuplicates(["__id", "__tie"])
    both = parts.join(texts, parts["doc_id"].eqNullSafe(texts["__id"]) & (parts["tie"] == texts["__tie"])).select("doc_id", "text", "parts")

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for frame in frames:
            for a, b in slabs_of(frame.column(1)):
                ids, first = coder.flat(frame.column(1)[a:b], end_id)
                found = []
                for doc_id, at, own in zip(frame.column(0)[a:b].to_pylist(), first.tolist(), frame.column(2)[a:b].to_pylist(), strict=False):
                    found += [(doc_id, p["start"], p["length"], zlib.crc32(ids[at + p["start"] : at + p["start"] + p["length"]].astype("<u4").tobytes()), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], [x.split()[0] for x in out.split(", ")])

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return both.mapInArrow(lean(encode), out)
