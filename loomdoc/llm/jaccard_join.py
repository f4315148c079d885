"""N-gram Jaccard join: sizes decide between subsets and inverted lists; components of the links.

Method. Documents with one shingle set are one node. Two sets of n <= m shingles link if they share c(n, m) shingles, the least
number with share/(n + m - share) >= threshold.
Light sets enumerate their subsets of each size c that a partner can ask for; two sets meet in a subset's list exactly if they
share so many, so such a link needs no proof, and a list's smallest set is linked with all that its size allows.
Heavy sets go to the inverted lists of their least shingles in hash order: all that the prefix filter asks for, but at most
sketch of them. Shingles of the union in order are common with a chance of threshold each, so two linked sets miss each other
with a chance of at most (1 - threshold) ** sketch, set to 1e-20: less than that of two 64-bit hashes being equal. whole_prefix
takes them all.
The boundary is the largest size up to which subsets cost less than lists (cost_of). Sizes near it do both.
A list is scanned with parity bitmaps: two sets that differ in d shingles have bitmaps that differ in at most d bits, so pairs
over the limit are no links. Of the rest a list names a spanning forest, closest pairs first; these pairs are verified with all
their shingles. Where one fails, the list then names every pair left between its parts, and these are verified too. So no pairs
of a group that already hangs together are named, and no link between different groups is lost.

Defined results. A-Z is lower-cased; words are runs of bytes other than \\x20 and \\x09-\\x0D; shingles are size consecutive words,
or all words of a shorter text. Texts without words, and nulls, have no shingles and link with nothing. A null doc_id is larger
than any other in a component; alone, its component_id is null. Repeated rows are documents of their own. Other columns are left
out. Empty tables give empty results.
"""

from __future__ import annotations

import math
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.blocks import NO_ID, Words, gram_hashes, group_count, grouped, ids_of, mix, ordered, pack, rows_of, spans, split_by, unpack
from loomdoc.llm.components import components
from loomdoc.session import file_count, written

MOST_WORDS = 256  # of a bitmap, 64 bits each


class Limits:
    """Integer arithmetic of 100 * shared >= percent * union."""

    def __init__(self, percent: int, whole_prefix: bool = False) -> None:
        self.percent = percent
        self.sketch = 1 << 62 if whole_prefix else 1 if percent >= 100 else math.ceil(-20 / math.log10(1 - percent / 100))
        self.light = max((n for n in range(1, 64) if self.cost_of(n)[0] <= self.cost_of(n)[1] and all(self.cost_of(k)[0] <= self.cost_of(k)[1] for k in range(1, n))), default=0)

    def shared(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        return range(-(-self.percent * n // 100), n * 100 // self.percent + 1)

    def sizes(self, n: int) -> list[int]:
        """Subset sizes that a partner of a set of n can ask for."""
        return sorted({c for m in self.partners(n) if 0 < (c := self.shared(n, m)) <= min(n, m)})

    def prefix(self, n: int) -> int:
        return int(self.prefixes(np.array([n]))[0])

    def prefixes(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(self.sketch, n - (-(-self.percent * n // 100)) + 1)

    def cost_of(self, n: int) -> tuple[float, float]:
        """Of subsets: one key each. Of lists: a key each, a bitmap and the verification of a set."""
        return sum(comb(n, c) for c in self.sizes(n)), self.prefix(n) + 8 + n

    def apart(self, total: np.ndarray) -> np.ndarray:
        """Shingles in which two linked sets with so many together can differ."""
        return total * (100 - self.percent) // (100 + self.percent)


def shingle_sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, by row and in hash order; where each row's begin; and a hash of each set."""
    words = Words(table["text"], lower=True)
    h = words.hashes()
    grams = gram_hashes(h, size)
    whole = words.doc[: len(grams)] == words.doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    rows, found = [words.doc[: len(grams)][whole]], [grams[whole]]
    for n in range(1, size):
        of = np.flatnonzero(words.count == n)
        if len(of):
            at = words.first[of]
            x = np.zeros(len(of), np.uint64)
            for j in range(n):
                x = x * np.uint64(0xD1342543DE82EF95) + h[at + j]
            rows.append(of)
            found.append(mix(x + np.uint64(n)))
    row, gram = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    row, gram = row[new], gram[new]
    first = np.searchsorted(row, np.arange(len(words) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(gram ^ np.uint64(0xA0761D6478BD642F)))])
    node = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    return gram, first, node


def _bitmap(gram: np.ndarray) -> np.ndarray:
    words = min(MOST_WORDS, max(4, 1 << int(np.ceil(np.log2(max(1, len(gram) / 16))))))
    bits = np.bincount((gram >> np.uint64(17)) % np.uint64(words * 64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def _fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set over fewer bits."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def _subsets(gram: np.ndarray, limits: Limits) -> list[tuple[np.ndarray, int]]:
    """(keys, size) for each size of subsets of one light set."""
    n, whole, out = len(gram), gram.sum(dtype=np.uint64), []
    for c in limits.sizes(n):
        without = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
        left = whole - gram[without].sum(axis=1, dtype=np.uint64)
        out.append((mix(left + np.uint64(c << 56)), c))
    return out


NODE, KEY, MAP = 0, 1, 2
SALTS = 16
BY_BUCKET = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("blob", pa.binary())])
PREPARED = pa.schema([("kind", pa.int32()), ("g", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("b", pa.int32()), ("blob", pa.binary())])
LISTED = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("blob", pa.binary()), ("node_a", pa.int64()), ("node_b", pa.int64())])
SETS = pa.schema([("p", pa.int32()), ("node", pa.int64()), ("blob", pa.binary())])
NAMED = pa.schema([("bucket", pa.int32()), *[(f"{k}{s}", t) for s in "ab" for k, t in (("node_", pa.int64()), ("g_", pa.int32()), ("row_", pa.int32()))]])
_NAMED = "bucket int, node_a long, g_a int, row_a int, node_b long, g_b int, row_b int"


def _lists(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Members of a bucket's lists of two nodes or more: key, kind, node, n, group, row; by key, then size and node."""
    got = [(g, *unpack(x.as_py())) for g, x in zip(table["g"].to_pylist(), table["blob"], strict=True)]
    key, kind, node, n, row = (np.concatenate([x[i] for x in got]) for i in range(1, 6))
    group = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
    order = np.lexsort((row, group, node, n, kind, key))
    key, kind, node, n, group, row = (x[order] for x in (key, kind, node, n, group, row))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (node[1:] != node[:-1])
    key, kind, node, n, group, row = (x[new] for x in (key, kind, node, n, group, row))
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    length = np.diff(np.flatnonzero(head), append=len(key))
    several = np.repeat(length > 1, length)
    return tuple(x[several] for x in (key, kind, node, n, group, row))


def _forest(nodes: np.ndarray, n: np.ndarray, maps: list[np.ndarray], limits: Limits, known: dict[tuple[int, int], bool] | None) -> list[tuple[int, int]]:
    """Pairs of a list to verify: a spanning forest of the pairs within the limit, or with known all pairs left between parts."""
    k = len(nodes)
    part = np.arange(k)
    if known is not None:
        at = {int(x): i for i, x in enumerate(nodes)}
        for (a, b), good in known.items():
            if good and a in at and b in at:
                part[part == part[at[b]]] = part[at[a]]
    width = np.array([len(x) for x in maps])
    stacked = {w: np.stack([_fold(x, w) if len(x) > w else np.pad(x, (0, w - len(x))) for x in maps]) for w in set(width.tolist())}
    low = np.searchsorted(n, -(-limits.percent * n // 100))
    near = []
    for i in range(1, k):
        a = low[i]
        if a == i:
            continue
        w = width[a:i]
        differ = np.empty(i - a, np.int64)
        for size in set(np.minimum(w, width[i]).tolist()):
            of = np.minimum(w, width[i]) == size
            differ[of] = np.bitwise_count(stacked[size][a:i][of] ^ stacked[size][i]).sum(1)
        for j in np.flatnonzero(differ <= limits.apart(n[a:i] + n[i])):
            near.append((differ[j] / (n[a + j] + n[i]), a + j, i)) if known is not None or k <= 64 else None
        if known is None and k > 64:  # long lists: the closest pair to each part at once, so that pairs aren't gathered
            good = np.flatnonzero(differ <= limits.apart(n[a:i] + n[i]))
            good = good[np.argsort(differ[good], kind="stable")]
            for x in np.unique(part[a:i][good], return_index=True)[1]:
                j = a + good[x]
                if part[j] != part[i]:
                    near.append((0, j, i))
                    part[part == part[j]] = part[i]
    if known is None and k > 64:
        return [(int(j), i) for _, j, i in near]
    out = []
    for _, j, i in sorted(near):
        if part[j] != part[i] and (known is None or (int(nodes[j]), int(nodes[i])) not in known):
            out.append((int(j), i))
            if known is None:
                part[part == part[j]] = part[i]
    return out


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, whole_prefix: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) for docs (doc_id, text).

    Two documents link if 100 * shared shingles >= percent * shingles of both together. whole_prefix: no sketch, so nothing is left to chance.
    """
    limits = Limits(percent, whole_prefix)
    groups = buckets = group_count(docs)
    files = file_count(docs)
    base = grouped(docs, groups)

    def prepare(table: pa.Table) -> pa.Table:
        """Of a group, in one pass: its rows (NODE), their keys by bucket (KEY), and the bitmaps of sets that go to lists (MAP)."""
        table = ordered(table)
        g, (gram, first, node) = table["g"][0].as_py(), shingle_sets(table, size)
        n = np.diff(first)
        some = np.flatnonzero(n > 0)
        some = np.sort(some[np.unique(node[some], return_index=True)[1]])  # copies within the group go once
        heavy = some[(n[some] > limits.light) | (n[some] * 100 // percent > limits.light)]
        many = limits.prefixes(n[heavy])
        key, kind, of = [gram[np.repeat(first[heavy], many) + spans(many)]], [np.zeros(many.sum(), np.uint8)], [np.repeat(heavy, many)]
        for i in some[n[some] <= limits.light].tolist():
            for x, c in _subsets(gram[first[i] : first[i + 1]], limits):
                key.append(x)
                kind.append(np.full(len(x), c, np.uint8))
                of.append(np.full(len(x), i))
        key, kind, of = np.concatenate(key), np.concatenate(kind), np.concatenate(of)
        parts = [(b, pack(key[x], kind[x], node[of[x]], n[of[x]].astype(np.uint32), of[x].astype(np.uint32))) for b, x in split_by((mix(key) % np.uint64(buckets)).astype(np.int64))]
        maps = [_bitmap(gram[first[i] : first[i + 1]]) for i in heavy.tolist()]
        blob = pack(heavy, node[heavy], n[heavy], np.array([len(x) for x in maps], np.int64), np.concatenate([np.zeros(0, np.uint64), *maps]))
        rows = pa.table({"kind": pa.array(np.full(len(table), NODE, np.int32)), "g": table["g"], "row": pa.array(np.arange(len(table)), pa.int32()), "doc_id": table["doc_id"], "n": pa.array(n, pa.int64()), "node": pa.array(node.view(np.int64)), "b": pa.nulls(len(table), pa.int32()), "blob": pa.nulls(len(table), pa.binary())}, schema=PREPARED)
        return pa.concat_tables([rows, rows_of(PREPARED, [(KEY, g, None, None, None, None, b, x) for b, x in parts] + [(MAP, g, None, None, None, None, None, blob)])])

    def listed(table: pa.Table) -> pa.Table:
        """Links that subsets prove (g is null); and by group the entries of lists that have a partner of a size that fits."""
        key, kind, node, n, group, row = _lists(table)
        kind, n, b = kind.astype(np.int64), n.astype(np.int64), table["b"][0].as_py()
        of = np.flatnonzero(kind > 0)
        new = np.ones(len(of), bool)
        new[1:] = (key[of][1:] != key[of][:-1]) | (kind[of][1:] != kind[of][:-1])
        hub = of[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(of) else of
        link = (-(-percent * (n[hub] + n[of]) // (100 + percent)) <= kind[of]) & (node[hub] != node[of])
        pairs = np.unique(np.stack([node[hub][link].view(np.int64), node[of][link].view(np.int64)], 1), axis=0)
        of = np.flatnonzero(kind == 0)
        key, n, group, row = key[of], n[of], group[of], row[of]
        fits = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])  # next to each other in size
        some = np.zeros(len(key), bool)
        some[1:] |= fits
        some[:-1] |= fits
        asked = [(int(g), b, pack(key[some][x], row[some][x]), None, None) for g, x in split_by(group[some])]
        return rows_of(LISTED, asked + [(None, b, None, int(x), int(y)) for x, y in pairs])

    def maps(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table) or not len(asked):
            return BY_BUCKET.empty_table()
        g, (rows, node, n, width, words) = table["g"][0].as_py(), unpack(table["blob"][0].as_py())
        begin = np.cumsum(width) - width
        out = []
        for b, blob in zip(asked["b"].to_pylist(), asked["blob"], strict=True):
            key, row = unpack(blob.as_py())
            at = np.searchsorted(rows, row)
            out.append((b, g, pack(key, node[at], n[at], row.astype(np.int64), width[at], words[np.repeat(begin[at], width[at]) + spans(width[at])])))
        return rows_of(BY_BUCKET, out)

    def named(table: pa.Table, known: pa.Table | None) -> pa.Table:
        if not len(table):
            return NAMED.empty_table()
        got = [(g, *unpack(x.as_py())) for g, x in zip(table["g"].to_pylist(), table["blob"], strict=True)]
        key, node, n, row, width, words = (np.concatenate([x[i] for x in got]) for i in range(1, 7))
        group = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
        begin = np.cumsum(width) - width
        order = np.lexsort((row, group, node, n, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (node[order][1:] != node[order][:-1])
        order = order[new]
        tried = None if known is None else {(a, b): good for a, b, good in zip(known["node_a"].to_pylist(), known["node_b"].to_pylist(), known["good"].to_pylist(), strict=True)}
        node = node.view(np.int64)
        pairs = set()
        for x in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(x) > 1:
                for j, i in _forest(node[x], n[x], [words[begin[y] : begin[y] + width[y]] for y in x.tolist()], limits, tried):
                    pairs.add((int(x[j]), int(x[i])))
        b = table["b"][0].as_py()
        return rows_of(NAMED, [(b, int(node[i]), int(group[i]), int(row[i]), int(node[j]), int(group[j]), int(row[j])) for i, j in sorted(pairs)])

    def sets(table: pa.Table, needed: pa.Table) -> pa.Table:
        """The sets that pairs need, sent to the places where pairs are verified; no other text is read."""
        if not len(table) or not len(needed):
            return SETS.empty_table()
        rows, at = np.unique(needed["row"].to_numpy(), return_inverse=True)
        gram, first, node = shingle_sets(ordered(table).take(rows), size)
        return rows_of(SETS, [(p, int(node[i].view(np.int64)), gram[first[i] : first[i + 1]].tobytes()) for p, i in zip(needed["p"].to_pylist(), at.tolist(), strict=True)])

    def verify(pairs: pa.Table, given: pa.Table) -> pa.Table:
        held = {x: np.frombuffer(blob.as_buffer(), np.uint64) for x, blob in zip(given["node"].to_pylist(), given["blob"], strict=True)} if len(pairs) else {}
        good = []
        for a, b in zip(pairs["node_a"].to_pylist(), pairs["node_b"].to_pylist(), strict=True):
            shared = len(np.intersect1d(held[a], held[b], assume_unique=True))
            good.append(100 * shared >= percent * (len(held[a]) + len(held[b]) - shared))
        return pa.table({"node_a": pairs["node_a"], "node_b": pairs["node_b"], "good": pa.array(good, pa.bool_())})

    bucketed = "b int, g int, blob binary"

    def verified(pairs: DataFrame) -> DataFrame:
        """A pair is verified at a place told by its first node and a salt, so that a node in many pairs is sent to a few places."""
        once = pairs.groupBy("node_a", "node_b").agg(F.min(F.struct("g_a", "row_a", "g_b", "row_b")).alias("at")).select("node_a", "node_b", "at.*")
        placed = once.withColumn("p", F.pmod(F.xxhash64("node_a", F.pmod("node_b", F.lit(64))), F.lit(buckets)).cast("int"))
        needed = placed.select(F.col("g_a").alias("g"), F.col("row_a").alias("row"), "p").union(placed.select("g_b", "row_b", "p")).distinct()
        sent = base.groupBy("g").cogroup(needed.groupBy("g")).applyInArrow(sets, "p int, node long, blob binary")
        return placed.select("p", "node_a", "node_b").groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(verify, "node_a long, node_b long, good boolean")

    prepared = written(base.groupBy("g").applyInArrow(prepare, "kind int, g int, row int, doc_id long, n long, node long, b int, blob binary"), "sets", "kind", files=files)
    node_rows = prepared.where(F.col("kind") == NODE).select("doc_id", "n", "node")
    lists = written(prepared.where(F.col("kind") == KEY).select("b", "g", "blob").groupBy("b").applyInArrow(listed, "g int, b int, blob binary, node_a long, node_b long"), "lists", files=files)
    certain = lists.where("g is null").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    asked = lists.where("g is not null").select("g", "b", "blob")
    mapped = written(prepared.where(F.col("kind") == MAP).select("g", "blob").groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(maps, bucketed), "bitmaps", files=files)
    first = written(mapped.groupBy("b").applyInArrow(lambda t: named(t, None), _NAMED), "pairs", files=files)
    proven = written(verified(first), "verified", files=files)
    links = [certain, proven.where("good").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))]
    failed = proven.where("not good").join(first, ["node_a", "node_b"]).select("bucket").distinct()
    if failed.limit(1).count():
        again = mapped.join(failed, mapped["b"] == failed["bucket"], "left_semi")
        tried = first.join(proven, ["node_a", "node_b"]).join(failed, "bucket", "left_semi").select(F.col("bucket").alias("b"), "node_a", "node_b", "good")
        rest = written(again.groupBy("b").cogroup(tried.groupBy("b")).applyInArrow(named, _NAMED), "pairs", files=files)
        links.append(written(verified(rest), "verified", files=files).where("good").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    edges = links[0].union(links[1])
    for more in links[2:]:
        edges = edges.union(more)
    part = components(edges).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    least = node_rows.where("n > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    linked = part.join(least, "node").select("node", "component", "salt", "least")
    # a large component is nobody's alone: its least doc_id goes to every salt
    whole = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.array([F.lit(x).cast("long") for x in range(SALTS)])))
    of_node = linked.join(whole, ["component", "salt"]).select(F.col("node").alias("__node"), F.col("component_id").alias("__least"))
    of_node = of_node.union(least.join(part, "node", "left_anti").select("node", "least"))
    found = node_rows.join(of_node, (F.col("node") == F.col("__node")) & (F.col("n") > 0), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("__least") != NO_ID, F.col("__least")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a document with a smaller doc_id; of rows with one doc_id all stay."""
    found = jaccard_components(docs, size, percent).where("component_id < doc_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__gone"]), "left_anti")
