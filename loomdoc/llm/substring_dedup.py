"""Substring dedup: FM-indexes over shards, searched backwards for windows that an earlier document has too.

Method. Each window of min_words words has an anchor, the least hash of its three-word grams, so equal windows have equal
anchors. Runs of windows with one anchor are segments. Anchors (not words) of all segments meet in buckets; those that only
one document has can't match and go no further. Equal segments of a group are settled there: only the least doc_id's goes on, so
a passage that all documents have comes from each group once. Segments of an anchor that HOT or more have are cut again, by the
least hash of their windows' six-word grams, so that a frequent anchor is no one shard's. Segments are sent to the shard of their
anchor, where distinct ones are indexed once (suffix order, wavelet matrix over word numbers) and streamed through backward search,
which gives each window's matching statistic and suffix interval; from min_words on the least doc_id in the interval decides.

Defined results. Words are runs of bytes other than \\x20 and \\x09-\\x0D. Null text: no words. A null doc_id counts as
larger than any other. Rows with the same doc_id are documents of their own that never remove each other's words. Windows are
judged on the input. Other columns are left out, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomdoc.llm.blocks import Words, gram_hashes, group_count, grouped, ids_of, mix, ordered, pack, rows_of, spans, split_by, unpack_all

ANCHOR = 3
HOT = 4096  # segments of an anchor from which on they are dealt by six words instead of three
LONGEST = 64  # words of a segment, or three times min_words if that is more; longer ones are cut with an overlap of min_words - 1


class FMIndex:
    """Suffix order and wavelet matrix of texts over 1.., joined by 0s. Bits are packed; counts are kept for each 64."""

    def __init__(self, text: np.ndarray) -> None:
        n = self.n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each end differs, so suffixes that meet one are told apart
        longest, step = int(np.diff(ends, prepend=-1).max(initial=1)), 1
        self.suffixes = np.argsort(rank, kind="stable")
        while step <= longest:
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = rank[step:] + 1
            key = rank * (n + int(text.max(initial=0)) + 2) + ahead
            self.suffixes = np.argsort(key, kind="stable")
            fresh = np.ones(n, np.int64)
            fresh[0] = 0
            fresh[1:] = np.diff(key[self.suffixes]) != 0
            rank = np.empty(n, np.int64)
            rank[self.suffixes] = np.cumsum(fresh)
            if rank[self.suffixes[-1]] == n - 1:
                break
            step *= 2
        sequence = text[self.suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])  # suffixes that start with a smaller symbol
        self.levels = []
        for bit in reversed(range(int(text.max(initial=1)).bit_length())):
            ones = (sequence >> bit) & 1 == 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.zeros(len(words), np.uint32)
            counts[1:] = np.cumsum(np.bitwise_count(words))[:-1]
            self.levels.append((bit, words, counts, n - int(ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        symbols = np.arange(len(self.before) - 1)
        self.base = self.before[:-1] - self._walk(symbols, np.zeros(len(symbols), np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, words, counts, zeros in self.levels:
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes of symbol + suffix begin, for suffixes from at on."""
        return self.base[symbol] + self._walk(symbol, at)

    def matching(self, text: np.ndarray, last: np.ndarray, depth: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each position of last: interval and length (up to depth) of the longest match that ends there.

        text holds numbers of this index's symbols, 0 where it has none. alone: intervals of one suffix may stop early.
        """
        inside = text[last] > 0
        lo, hi = self.before[text[last]], self.before[np.minimum(text[last] + 1, len(self.before) - 1)]
        length = inside.astype(np.int64)
        live = np.flatnonzero(inside & (hi > lo) & (hi - lo > 1 if alone else True))
        for back in range(1, depth):
            live = live[last[live] >= back]
            symbol = text[last[live] - back]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            if not len(live):
                break
            a, b = self.step(symbol, lo[live]), self.step(symbol, hi[live])
            found = b > a
            live, a, b = live[found], a[found], b[found]
            lo[live], hi[live] = a, b
            length[live] += 1
            if alone:
                live = live[b - a > 1]
        return lo, hi, length


def least_in(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi]; intervals are equal or disjoint."""
    starts, first, back = np.unique(lo, return_index=True, return_inverse=True)
    edges = np.stack([starts, hi[first]], 1).ravel()
    return np.minimum.reduceat(np.append(values, np.iinfo(np.int64).max), edges)[::2][back]


def _runs(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor, row, first window (word index within the whole group), number of windows."""
    h = words.hashes()
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return h, none.astype(np.uint64), none, none, none
    anchor = gram_hashes(h, min(ANCHOR, size))
    width = size - min(ANCHOR, size) + 1
    least, have = anchor, 1
    while have < width:
        more = min(have, width - have)
        least, have = np.minimum(least[:-more], least[more:]), have + more
    windows = len(h) - size + 1
    least = least[:windows]
    row = words.doc[:windows]
    whole = row == words.doc[size - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return h, none.astype(np.uint64), none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(begin, append=len(at))
    most = max(1, max(LONGEST, 3 * size) - size + 1)
    pieces = -(-count // most)
    part = spans(pieces)
    begin = np.repeat(begin, pieces) + part * most
    count = np.minimum(most, np.repeat(count, pieces) - part * most)
    return h, least[at[begin]], row[at[begin]], at[begin], count


def _contents(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of all words of each segment; words of one after those of the other."""
    begin = np.cumsum(length) - length
    with np.errstate(over="ignore"):
        weighted = words * np.multiply.accumulate(np.full(int(length.max(initial=0)) + 1, np.uint64(0xD6E8FEB86659FD93)))[spans(length)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)])
        return total[begin + length] - total[begin] + length.astype(np.uint64)


def _finer(h: np.ndarray, size: int, anchor: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments cut where the least hash of their windows' six-word grams changes: key, segment, first window, number of windows."""
    width = min(2 * ANCHOR, size)
    grams = gram_hashes(h, width)
    window = np.repeat(at, count) + spans(count)
    least = grams[window]
    for j in range(1, size - width + 1):
        least = np.minimum(least, grams[window + j])
    of = np.repeat(np.arange(len(at)), count)
    new = np.ones(len(window), bool)
    new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    return mix(anchor[of[begin]] ^ least[begin]), of[begin], window[begin], np.diff(begin, append=len(window))


def _shard(table: pa.Table, size: int) -> list[tuple[int, bytes]]:
    """Windows of a shard's segments that a smaller doc_id has too, by group."""
    group, row, doc, start, length, words = [], [], [], [], [], []
    out = []
    for g, blob in zip(table["g"].to_pylist(), table["blob"], strict=True):
        found = unpack_all([blob])
        if len(found) == 2:  # what a group has settled by itself
            out.append((g, blob.as_py()))
            continue
        group.append(np.full(len(found[0]), g))
        for into, x in zip((row, doc, start, length, words), found, strict=True):
            into.append(x)
    if not group:
        return out
    group, row, doc, start, length, words = map(np.concatenate, (group, row, doc, start, length, words))
    length = length.astype(np.int64)
    begin = np.cumsum(length) - length
    content = _contents(words, length)
    _, some, which = np.unique(content, return_index=True, return_inverse=True)
    owner = np.full(len(some), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, doc)
    n = length[some]
    place = np.cumsum(n + 1) - (n + 1)
    _, symbol = np.unique(words, return_inverse=True)
    text = np.zeros(int((n + 1).sum()), np.int64)
    inner = spans(n)
    text[np.repeat(place, n) + inner] = symbol[np.repeat(begin[some], n) + inner] + 1
    index = FMIndex(text)
    of_suffix = owner[np.searchsorted(place, index.suffixes, side="right") - 1]
    windows = n - size + 1
    segment = np.repeat(np.arange(len(some)), windows)
    last = np.repeat(place, windows) + spans(windows) + size - 1
    least = owner[segment]
    for i in range(0, len(last), 1 << 18):
        lo, hi, matched = index.matching(text, last[i : i + (1 << 18)], size, alone=True)
        shared = np.flatnonzero((matched >= size) & (hi - lo > 1))
        if len(shared):
            least[i + shared] = np.minimum(least[i + shared], least_in(of_suffix, lo[shared], hi[shared]))
    offset = np.cumsum(windows) - windows
    many = length - size + 1
    hit = np.repeat(np.arange(len(doc)), many)
    inner = spans(many)
    removed = least[np.repeat(offset[which], many) + inner] < doc[hit]
    hit, inner = hit[removed], inner[removed]
    return out + [(g, pack(row[hit[x]], (start[hit[x]] + inner[x]).astype(np.uint32))) for g, x in split_by(group[hit])]


BY_GROUP = pa.schema([("g", pa.int32()), ("blob", pa.binary())])
BY_BUCKET = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("blob", pa.binary())])


def repeated_windows(docs: DataFrame, groups: int, min_words: int) -> DataFrame:
    """(g, blob): rows of group g and the first words of their windows that a smaller doc_id has too. docs as of grouped()."""
    size, buckets = min_words, groups

    def anchors(table: pa.Table) -> pa.Table:
        g, words = table["g"][0].as_py(), Words(ordered(table)["text"])
        _, anchor, row, at, _ = _runs(words, size)
        return rows_of(BY_BUCKET, [(b, g, pack(anchor[x], row[x].astype(np.uint32), (at[x] - words.first[row[x]]).astype(np.uint32))) for b, x in split_by((anchor % np.uint64(buckets)).astype(np.int64))])

    def shared(table: pa.Table) -> pa.Table:
        got = [(g, *unpack_all([blob])) for g, blob in zip(table["g"].to_pylist(), table["blob"], strict=True)]
        anchor, row, at = (np.concatenate([x[i] for x in got]) for i in (1, 2, 3))
        group = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
        order = np.argsort(anchor, kind="stable")
        ident = (group[order].astype(np.int64) << 32) | row[order]
        head = np.ones(len(order), bool)
        head[1:] = anchor[order][1:] != anchor[order][:-1]
        head = np.flatnonzero(head)
        several = np.minimum.reduceat(ident, head) != np.maximum.reduceat(ident, head)
        many = np.diff(head, append=len(order))
        keep, hot = order[np.repeat(several, many)], np.repeat(many[several] > HOT, many[several]).astype(np.uint8)
        return rows_of(BY_GROUP, [(g, pack(row[keep[x]], at[keep[x]], hot[x])) for g, x in split_by(group[keep])])

    def segments(table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(table) or not len(wanted):
            return BY_BUCKET.empty_table()
        table = ordered(table)
        g, words, ids = table["g"][0].as_py(), Words(table["text"]), ids_of(table)
        row, place, hot = unpack_all(wanted["blob"])
        h, anchor, of, at, count = _runs(words, size)
        ask, have = (row.astype(np.int64) << 32) | place, (of << 32) | (at - words.first[of])
        order = np.argsort(ask)
        place = np.minimum(np.searchsorted(ask[order], have), len(ask) - 1)
        pick = np.flatnonzero(ask[order][place] == have)
        hot = hot[order][place[pick]] > 0
        cold, hot = pick[~hot], pick[hot]
        key, of_hot, at_hot, count_hot = _finer(h, size, anchor[hot], at[hot], count[hot])
        key, of = np.concatenate([anchor[cold], key]), np.concatenate([of[cold], of[hot][of_hot]])
        at, count = np.concatenate([at[cold], at_hot]), np.concatenate([count[cold], count_hot])
        length, doc, start = count + size - 1, ids[of], at - words.first[of]
        # equal segments of a group meet here: but for the least doc_id, all their windows go, and they go no further
        _, which = np.unique(_contents(h[np.repeat(at, length) + spans(length)], length), return_inverse=True)
        owner = np.full(len(which), np.iinfo(np.int64).max)
        np.minimum.at(owner, which, doc)
        settled, left = np.flatnonzero(doc > owner[which]), np.flatnonzero(doc == owner[which])
        out = []
        if len(settled):
            many = count[settled]
            out.append((g % buckets, g, pack(np.repeat(of[settled], many).astype(np.uint32), (np.repeat(start[settled], many) + spans(many)).astype(np.uint32))))
        for b, x in split_by((key[left] % np.uint64(buckets)).astype(np.int64)):
            x = left[x]
            n = length[x]
            out.append((b, g, pack(of[x].astype(np.uint32), doc[x], start[x].astype(np.uint32), n.astype(np.uint32), h[np.repeat(at[x], n) + spans(n)])))
        return rows_of(BY_BUCKET, out)

    def shard(table: pa.Table) -> pa.Table:
        return rows_of(BY_GROUP, _shard(table, size))

    bucketed, by_group = "b int, g int, blob binary", "g int, blob binary"
    wanted = docs.groupBy("g").applyInArrow(anchors, bucketed).groupBy("b").applyInArrow(shared, by_group)
    parts = docs.groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(segments, bucketed)
    return parts.groupBy("b").applyInArrow(shard, by_group)


def substring_dedup(docs: DataFrame, min_words: int = 13, keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Each document without the words that windows repeated from a smaller doc_id cover.

    docs: doc_id, text. Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), the columns of keep,
    and with with_text: text (what is left; stretches of kept words as they stood, joined by a space; untouched texts as they
    were) and spans (array of [first word, number of words] removed).
    """
    groups = group_count(docs)
    base = grouped(docs, groups, *keep)
    kinds = {f.name: f.dataType for f in base.schema}
    extra = [(c, kinds[c].simpleString()) for c in keep]

    def finish(table: pa.Table, removed: pa.Table) -> pa.Table:
        table = ordered(table)
        words = Words(table["text"])
        gone = np.zeros(len(words.start) + 1, np.int64)
        if len(removed):
            row, at = unpack_all(removed["blob"])
            at = words.first[row] + at
            np.add.at(gone, at, 1)
            np.add.at(gone, np.minimum(at + min_words, len(words.start)), -1)
        gone = np.cumsum(gone)[:-1] > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        lost = lost[words.first[1:]] - lost[words.first[:-1]]
        digests, texts, cuts = [], [], []
        for i in range(len(words)):
            mine = words.words(i)
            a, b = words.first[i], words.first[i + 1]
            if lost[i]:
                digests.append(hashlib.sha256(b" ".join(compress(mine, ~gone[a:b]))).hexdigest())
            else:
                digests.append(hashlib.sha256(b" ".join(mine)).hexdigest())
            if with_text:
                edge = np.flatnonzero(np.diff(np.concatenate([[1], gone[a:b], [1]])))
                left = edge.reshape(-1, 2) if lost[i] else ()
                texts.append(" ".join(words.data[words.start[a + x] : words.end[a + y - 1]].tobytes().decode() for x, y in left) if lost[i] else table["text"][i].as_py())
                cut = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]))).reshape(-1, 2) if lost[i] else np.zeros((0, 2), np.int64)
                cuts.append([[int(x), int(y - x)] for x, y in cut])
        out = {"doc_id": table["doc_id"], "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        out |= {c: table[c] for c, _ in extra}
        if with_text:
            out |= {"text": pa.array(texts, pa.string()), "spans": pa.array(cuts, pa.list_(pa.list_(pa.int64())))}
        return pa.table(out)

    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept_sha256 string", *[f"`{c}` {t}" for c, t in extra], *["text string, spans array<array<long>>"] * with_text])
    return base.groupBy("g").cogroup(repeated_windows(base, groups, min_words).groupBy("g")).applyInArrow(finish, schema)
