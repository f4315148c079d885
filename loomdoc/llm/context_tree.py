"""LM scoring by context-tree weighting over bytes.

Method. A text is its bytes with A-Z lower-cased, then one end symbol. A symbol's 8 bits are decisions, each with a context tree
of its own over the depth symbols before it, the nearest first. A node holds the training counts of zeros and ones in its
context; its Krichevsky-Trofimov block probability Pe and its children's weighted ones give Pw = (Pe + prod Pw(child)) / 2, at
depth Pw = Pe. A bit's probability is Pw with that bit after the training bits, over Pw without: at each node the share
Pe / 2 / Pw of its own estimate and the rest of its child's, so it mixes the estimates of all depths on its path. A context
that training never saw has the estimate 1/2 at all depths, as Pw of no bits is 1. Code length per byte follows.

Counts are of all training texts. Groups of documents name their grams (context and symbol) once each with their counts; buckets
by the nearest three bytes add them up, hold whole subtrees below depth 3, one bit's at a time, and answer each gram's probability
to the groups that named it. Depths 2 to 0 are at most 256 * 256 * 255 nodes, however many documents there are (some ten thousands
here): summed on the executors, joined on the driver and broadcast. What is gathered so grows with the input. Words for the base go
the same way, by hash.

Defined results. A null text is empty: the end symbol alone. A null doc_id is held out from training by nothing (its crc32 is null).
Repeated rows and null ids give a row each. Other columns are left out. Without training texts each bit has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.blocks import Bytes, Words, as_arrays, as_bytes, group_count, mix, ordered, rows_of, slabs_of, split_by
from loomdoc.session import written

END = 0xFF  # in no UTF-8 text: ends a text, and stands before its first byte
GRAM, WORD = 0, 1
LN10 = np.log(10)
UNIT = 1_000_000  # probabilities travel as whole millionths of their log10, in 32 bits
SLAB = 1 << 20  # bytes of text whose symbols are held as arrays at once
TOP = 2  # depths up to this are joined on the driver
GROUP_BYTES = 8 << 20  # the more texts a group has, the fewer keys it names for each byte


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series, moved up by 8."""
    down = np.ones_like(x)
    for i in range(8):
        down *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


_MANY = np.arange(1 << 12)
_HALVES, _WHOLES = log_gamma(_MANY + 0.5), log_gamma(_MANY + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    n = zeros + ones
    few = np.minimum(n, len(_MANY) - 1).astype(np.int64)
    out = _HALVES[np.minimum(zeros, few).astype(np.int64)] + _HALVES[np.minimum(ones, few).astype(np.int64)] - _WHOLES[few]
    of = np.flatnonzero(n >= len(_MANY))
    out[of] = log_gamma(zeros[of] + 0.5) + log_gamma(ones[of] + 0.5) - log_gamma(n[of] + 1.0)
    return out - np.log(np.pi)


def grams_of(texts: Bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each symbol: nearest byte of the context highest, the symbol lowest; and the number of symbols of each text."""
    sizes = np.diff(texts.offsets)
    lead = (np.arange(len(texts)) + 1) * depth + np.arange(len(texts))
    flat = np.full(len(texts.data) + len(texts) * (depth + 1), END, np.uint8)
    flat[np.arange(len(texts.data)) + np.repeat(lead, sizes)] = texts.data
    real = np.ones(len(flat), bool)
    begin = texts.offsets[:-1] + np.arange(len(texts)) * (depth + 1)
    for j in range(depth):
        real[begin + j] = False
    at = np.flatnonzero(real)
    gram = flat[at].astype(np.uint64)
    for j in range(1, depth + 1):
        gram |= flat[at - j].astype(np.uint64) << np.uint64(8 * (depth + 1 - j))
    return gram, sizes + 1


class Level:
    """Nodes of one depth for one bit: keys (context, bits before), counts of zeros and ones, and the node of each pair."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, bit: int, child: Level | None) -> None:
        """child: the level one deeper."""
        key = pairs >> np.uint64(8 - bit)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.of_pair = (np.cumsum(new) - 1).astype(np.int32)
        self.keys = key[new]
        one = (pairs >> np.uint64(7 - bit)) & np.uint64(1) == 1
        self.ones = np.bincount(self.of_pair, np.where(one, counts, 0), len(self.keys))
        self.zeros = np.bincount(self.of_pair, np.where(one, 0, counts), len(self.keys))
        pe = log_kt(self.zeros, self.ones)
        self.pw, self.stop = pe, None
        if child is not None:
            low = np.uint64((1 << bit) - 1)
            parent = ((child.keys >> np.uint64(8 + bit)) << np.uint64(bit)) | (child.keys & low)
            self.pw = np.log(0.5) + np.logaddexp(pe, np.bincount(np.searchsorted(self.keys, parent), child.pw, len(self.keys)))
            self.stop = np.exp(np.log(0.5) + pe - self.pw)

    def mixed(self, node: np.ndarray, one: np.ndarray, p: np.ndarray | None) -> np.ndarray:
        """The probability of a bit at nodes, whose children give it p."""
        own = (np.where(one, self.ones[node], self.zeros[node]) + 0.5) / (self.zeros[node] + self.ones[node] + 1.0)
        return own if p is None else p + self.stop[node] * (own - p)


class Subtrees:
    """The nodes below depth TOP for grams (sorted, distinct) with training counts; one bit's are held at a time."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.grams, self.depth, self.pairs = grams, depth, {}
        for d in range(depth, TOP, -1):
            context = grams >> np.uint64(8 * (depth + 1 - d))
            pairs, back = np.unique((context << np.uint64(8)) | (grams & np.uint64(0xFF)), return_inverse=True)
            self.pairs[d] = pairs, back.astype(np.int32), np.bincount(back, counts, len(pairs))

    def levels(self, bit: int) -> dict[int, Level]:
        out = {}
        for d, (pairs, _, counts) in self.pairs.items():
            out[d] = Level(pairs, counts, bit, out.get(d + 1))
        return out

    def upwards(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For depth TOP: node (context, then heap place of the bits), sums of ln Pw below, zeros and ones."""
        out = []
        for bit in range(8):
            x = self.levels(bit)[TOP + 1]
            node = ((x.keys >> np.uint64(8 + bit)) << np.uint64(8)) | np.uint64(1 << bit) | (x.keys & np.uint64((1 << bit) - 1))
            ids, back = np.unique(node, return_inverse=True)
            out.append((ids.astype(np.int64), *[np.bincount(back, v, len(ids)) for v in (x.pw, x.zeros, x.ones)]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def log10(self, top: Top) -> np.ndarray:
        """log10 of each gram's probability."""
        symbol = (self.grams & np.uint64(0xFF)).astype(np.int64)
        near = (self.grams >> np.uint64(8 * (self.depth + 1 - TOP))).astype(np.int64)
        total = np.zeros(len(self.grams))
        for bit in range(8):
            one, p = (symbol >> (7 - bit)) & 1 == 1, None
            for d, level in self.levels(bit).items():
                p = level.mixed(level.of_pair[self.pairs[d][1]], one, p)
            total += np.log(top.bit(near, (1 << bit) | (symbol >> (8 - bit)), one, p))
        return total / LN10


class Top:
    """Depths 2 to 0. node: at depth 2, both bytes of the context, then the heap place of the bits before."""

    def __init__(self, node: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.levels = []
        while True:
            node, back = np.unique(node, return_inverse=True)
            zeros, ones, below = (np.bincount(back, x, len(node)) for x in (zeros, ones, below))
            pe = log_kt(zeros, ones)
            pw = np.log(0.5) + np.logaddexp(pe, below)
            self.levels.append((node, zeros, ones, np.exp(np.log(0.5) + pe - pw)))
            if not (node >> 8).any():
                break
            node, below = ((node >> 16) << 8) | (node & 0xFF), pw

    def bit(self, near: np.ndarray, place: np.ndarray, one: np.ndarray, p: np.ndarray) -> np.ndarray:
        for d, (node, zeros, ones, stop) in zip(range(TOP, -1, -1), self.levels, strict=True):
            at = np.searchsorted(node, ((near >> (8 * (TOP - d))) << 8) | place)
            own = (np.where(one, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            p = p + stop[at] * (own - p)
        return p


NAMED = pa.schema([("kind", pa.int32()), ("b", pa.int32()), ("g", pa.int32()), ("blob", pa.binary())])
ANSWER = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("b", pa.int32()), ("blob", pa.binary())])
_NAMED, _ANSWER = "kind int, b int, g int, blob binary", "g int, kind int, b int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(as_bytes(*arrays), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    return as_arrays(zstandard.decompress(blob))


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of the same place side by side, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).ravel()


def _flat(x: np.ndarray, kind: type | np.dtype) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).ravel().view(kind)


def _keys_out(keys: np.ndarray) -> np.ndarray:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys_in(x: np.ndarray) -> np.ndarray:
    return np.cumsum(_flat(x, np.uint64), dtype=np.uint64)


def _sums(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts over many blobs."""
    rows = [unpack(x.as_py()) for x in blobs]
    keys, counts = np.concatenate([_keys_in(r[0]) for r in rows]), np.concatenate([_flat(r[1], np.uint32) for r in rows])
    del rows
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64)


def _merged(every: np.ndarray, count: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct keys with their counts, taken into every (sorted, distinct) and its counts."""
    at = np.searchsorted(every, keys)
    have = at < len(every)
    have[have] = every[at[have]] == keys[have]
    count[at[have]] += n[have]
    return np.insert(every, at[~have], keys[~have]), np.insert(count, at[~have], n[~have])


class Group:
    """A group's texts, slab by slab; its distinct keys of each kind, and which of them each bucket has."""

    def __init__(self, table: pa.Table, depth: int, buckets: int) -> None:
        self.table = ordered(table)
        self.depth, self.buckets = depth, buckets
        self.slabs = slabs_of(self.table["text"], SLAB)
        self.lesson = self.table["lesson"].to_numpy().astype(bool)

    def keys(self, kind: int):
        """(slab, its words, keys, row of each key) for each slab."""
        for a, b in self.slabs:
            words = Words(self.table["text"][a:b], lower=True)
            if kind == WORD:
                yield a, words, words.hashes(), words.doc
            else:
                gram, sizes = grams_of(words, self.depth)
                yield a, words, gram, np.repeat(np.arange(b - a, dtype=np.int32), sizes)

    def counted(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often training texts have each."""
        every, count = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        for a, _, keys, row in self.keys(kind):
            of = self.lesson[a + row]
            key, n = np.unique(keys[of], return_counts=True)
            every, count = _merged(every, count, key, n.astype(np.uint32))
            key = np.unique(keys[~of])
            every, count = _merged(every, count, key, np.zeros(len(key), np.uint32))
        return every, count

    def placed(self, kind: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Distinct keys in order; and for each slab its first row, distinct keys, which of them each key is, and keys of each row."""
        slabs, every, none = [], np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        for a, words, keys, _ in self.keys(kind):
            found, back = np.unique(keys, return_inverse=True)
            slabs.append((a, found, back.astype(np.int32), words.count if kind == WORD else np.diff(words.offsets) + 1))
            every, none = _merged(every, none, found, np.zeros(len(found), np.uint8))
        return every, slabs

    def parts(self, kind: int, keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Keys by bucket: words by hash, grams by their nearest three bytes, so that a bucket's keys lie close and pack well."""
        place = keys if kind == WORD else keys >> np.uint64(8 * (self.depth - TOP))
        return split_by((mix(place) % np.uint64(self.buckets)).astype(np.int64))


def context_tree_scores(docs: DataFrame, teaches: Callable[[Column], Column], depth: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of docs (doc_id, text).

    teaches: of the doc_id, whether a text may be learned from. base_score: words and an end, each log10((c + 0.1) / (N + 0.1 * (V + 1))).
    """
    if not TOP < depth < 8:
        raise ValueError("depth: 3 to 7")
    spark = docs.sparkSession
    groups = buckets = group_count(docs, GROUP_BYTES, least=16)
    base = grouped_with(docs, groups, teaches)

    def name(table: pa.Table) -> pa.Table:
        group = Group(table, depth, buckets)
        g, out = table["g"][0].as_py(), []
        for kind in (GRAM, WORD):
            keys, counts = group.counted(kind)
            out += [(kind, b, g, pack(_keys_out(keys[x]), _planes(counts[x]))) for b, x in group.parts(kind, keys)]
        return rows_of(NAMED, out)

    def up(table: pa.Table) -> pa.Table:
        node, below, zeros, ones = Subtrees(*_sums(table["blob"]), depth).upwards()
        return pa.table({"node": pa.array(node), "below": pa.array(below), "zeros": pa.array(zeros), "ones": pa.array(ones)})

    def words_total(table: pa.Table) -> pa.Table:
        _, counts = _sums(table["blob"])
        return pa.table({"n": pa.array([int(counts.sum())], pa.int64()), "v": pa.array([int((counts > 0).sum())], pa.int64())})

    def answered(kind: int, table: pa.Table, keys: np.ndarray, values: np.ndarray) -> pa.Table:
        """To each group the values of the keys that it named, in its order."""
        b = table["b"][0].as_py()
        return rows_of(ANSWER, [(g, kind, b, pack(_planes(values[np.searchsorted(keys, _keys_in(unpack(x.as_py())[0]))]))) for g, x in zip(table["g"].to_pylist(), table["blob"], strict=True)])

    def answer_words(table: pa.Table) -> pa.Table:
        return answered(WORD, table, *_sums(table["blob"]))

    def answer_grams(table: pa.Table) -> pa.Table:
        tree = Subtrees(*_sums(table["blob"]), depth)
        return answered(GRAM, table, tree.grams, np.round(-UNIT * tree.log10(top.value)).astype(np.int32))

    named = written(base.groupBy("g").applyInArrow(name, _NAMED), "named", "kind")
    grams, words = (named.where(F.col("kind") == k).select("b", "g", "blob") for k in (GRAM, WORD))
    sums = grams.groupBy("b").applyInArrow(up, "node long, below double, zeros double, ones double").groupBy("node").agg(F.sum("below").alias("below"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    sums = sums.toArrow().sort_by("node")  # at most 256 * 256 * 255 nodes
    top = spark.sparkContext.broadcast(Top(*(sums[c].to_numpy() for c in ("node", "below", "zeros", "ones"))) if len(sums) else None)
    total = words.groupBy("b").applyInArrow(words_total, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    lessons = base.where("lesson").count()
    n_train, distinct = (total[0] or 0) + lessons, (total[1] or 0) + (lessons > 0)
    answers = grams.groupBy("b").applyInArrow(answer_grams, _ANSWER).union(words.groupBy("b").applyInArrow(answer_words, _ANSWER))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(table, depth, buckets)
        n = len(table)
        unit = n_train + 0.1 * (distinct + 1)
        got = {(k, b): x for k, b, x in zip(answers["kind"].to_pylist(), answers["b"].to_pylist(), answers["blob"], strict=True)}
        scores, sizes, count = np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64)
        bases, known = np.full(n, np.log10((lessons + 0.1) / unit)), np.full(n, int(lessons > 0), np.int64)
        for kind in (GRAM, WORD):
            every, slabs = group.placed(kind)
            value = np.zeros(len(every), np.int32 if kind == GRAM else np.int64)
            for b, x in group.parts(kind, every):
                value[x] = _flat(unpack(got.pop((kind, b)).as_py())[0], value.dtype)
            while slabs:  # values of sorted keys, then by place: no search in a large table for each byte
                a, found, back, many = slabs.pop()
                each, m = value[np.searchsorted(every, found)][back], len(many)
                row = np.repeat(np.arange(m), many)
                if kind == GRAM:
                    scores[a : a + m] = -np.bincount(row, each, m) / UNIT
                    sizes[a : a + m] = many
                else:
                    count[a : a + m] = many
                    bases[a : a + m] += np.bincount(row, np.log10((each + 0.1) / unit), m)
                    known[a : a + m] += np.bincount(row, each > 0, m).astype(np.int64)
        table = group.table
        return pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array(~group.lesson), "n_tokens": pa.array(count + 1, pa.int64()), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(n, n_train, np.int64)), "base_score": pa.array(bases), "score": pa.array(scores), "bits_per_byte": pa.array(-scores * np.log2(10) / sizes),
        })

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return base.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, out)


def grouped_with(docs: DataFrame, groups: int, teaches: Callable[[Column], Column]) -> DataFrame:
    """(g, doc_id, text, lesson), dealt by g."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    g = F.pmod(F.xxhash64(doc_id, text), F.lit(groups)).cast("int")
    lesson = F.coalesce(teaches(doc_id), F.lit(True))
    return docs.select(g.alias("g"), doc_id.alias("doc_id"), text.alias("text"), lesson.alias("lesson")).repartition("g")
