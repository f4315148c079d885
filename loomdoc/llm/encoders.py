"""Public tokenizers by file: .json by tokenizers, .model by sentencepiece. One is kept for each Python worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomdoc.llm.blocks import SPACE, Bytes, span_hashes

MEMO, MEMO_IDS, MEMO_BITS = 1_000_000, 1 << 23, 21  # parts and ids that a worker remembers, and slots of the table: some 100 MB
BUNDLE = 2000
_KINDS = ("other", "letter", "digit", "mark", "blank", "space", "apostrophe")  # other: not ASCII
KIND = np.array([0 if b >= 0x80 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 5 if b == 0x20 else 4 if SPACE[b] else 6 if b == 0x27 else 3 for b in range(256)], np.uint8)
_MARKS = {"mark", "apostrophe"}


def _pairs(rule: Callable[[str, str], bool]) -> np.ndarray:
    return np.array([i < 56 and i % 8 < 7 and rule(_KINDS[i // 8], _KINDS[i % 8]) for i in range(64)])


#: Whether text is cut between two kinds; and whether the first is the last white space before a word.
APART = _pairs(lambda a, b: (b in ("blank", "space")) > (a in ("blank", "space")) or (a == "blank" and b not in ("blank", "space")) or (a != b and {a, b} <= {"letter", "digit", *_MARKS} and not {a, b} <= _MARKS and (a, b) != ("apostrophe", "letter")))
LAST = _pairs(lambda a, b: a in ("blank", "space") and b not in ("blank", "space"))
#: White space other than ASCII's.
_BLANKS = ["[\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"]


def vocabulary(name: str) -> str:
    """The place of a vocabulary file on the machine that runs this: a path, or a name known to public_tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Token ids of distinct parts by their 64-bit hash: an open-addressing table over one array of ids."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)  # key 0: free
        self.at, self.many, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.names, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)  # the key of each part, and whether it was met again

    def __len__(self) -> int:
        return len(self.at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's part, -1 where it has none."""
        slot = (keys & self.mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.number[slot], -1)
        live = np.flatnonzero((held != keys) & (held != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & int(self.mask)
            held = self.keys[slot[live]]
            hit = held == keys[live]
            out[live[hit]] = self.number[slot[live[hit]]]
            live = live[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """keys: distinct and new; ids: of all of them, one after the other, many of each."""
        number = np.arange(len(self), len(self) + len(keys), dtype=np.int32)
        slot, left = (keys & self.mask).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.number[slot[free]] = keys[free], number[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)
        self.names, self.again = np.append(self.names, keys), np.append(self.again, np.zeros(len(keys), bool))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(many) - many)
        self.many = np.append(self.many, many)
        self.ids = np.append(self.ids, ids.astype(np.uint32))


    def kept(self, bits: int, most: int, most_ids: int) -> Memo:
        """A table of the parts that were met again, or an empty one if these are too many."""
        out, of = Memo(bits), np.flatnonzero(self.again)
        many = self.many[of]
        if len(of) <= most and many.sum() <= most_ids:
            place = np.cumsum(many) - many
            out.add(self.names[of], self.ids[np.arange(many.sum()) + np.repeat(self.at[of] - place, many)], many)
        return out


class JsonEncoder:
    """The tokenizers library with add_special_tokens=False; special strings in a text are handled as its default."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.size = self.model.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.begins = {}  # ids that begin with a space, or a line feed
        for mark, shown in ((b" ", "Ġ"), (b"\n", "Ċ")):
            self.begins[mark] = np.zeros(max(vocab.values(), default=0) + 1, bool)
            self.begins[mark][[i for piece, i in vocab.items() if piece.startswith(shown)]] = True
        about = json.loads(self.model.to_str())
        split = about.get("pre_tokenizer") or {}
        self.in_parts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not about.get("normalizer") and not about["model"].get("dropout")
        self.whole = "|".join([*map(re.escape, filter(None, self.special)), *_BLANKS])
        self.memo = Memo(MEMO_BITS)

    def flat(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), 32 bits each, with end_id after each; and where each text's begin, then the end.

        Byte-level vocabularies cut text by a fixed rule before any merge: letters, digits and other marks stand apart, and so does
        white space, but for a space before a word, which the word takes. Where texts hold no other white space than ASCII's and no
        special strings, the library so encodes each distinct part once; a part is known by its hash. Only cuts between ASCII marks
        are used, and none after an apostrophe, which may take letters. All other texts are encoded whole.
        """
        column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
        text = Bytes(column)
        whole = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False) if self.in_parts else np.ones(len(text), bool)
        start, row = self._parts(text, whole)
        end = np.append(start[1:], len(text.data))
        alone = whole[row]
        known = np.flatnonzero(~alone)
        at, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        key = np.maximum(span_hashes(text.data, start, end)[known], np.uint64(1))
        number = self.memo.find(key)
        self.memo.again[number[number >= 0]] = True
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            if len(self.memo) + len(fresh) > MEMO or len(self.memo.ids) > MEMO_IDS:
                self.memo = self.memo.kept(MEMO_BITS, MEMO // 2, MEMO_IDS // 2)
                fresh = np.flatnonzero(self.memo.find(key) < 0)
            first = fresh[np.unique(key[fresh], return_index=True)[1]]
            self._learn(key[first], [text.data[a:b].tobytes() for a, b in zip(start[known[first]].tolist(), end[known[first]].tolist(), strict=True)])
            number = self.memo.find(key)
        at[known], many[known] = self.memo.at[number], self.memo.many[number]
        source = self.memo.ids
        if alone.any():
            found = self.ids([text.data[a:b].tobytes().decode() for a, b in zip(start[alone].tolist(), end[alone].tolist(), strict=True)])
            many[alone] = [len(x) for x in found]
            at[alone] = len(source) + np.cumsum(many[alone]) - many[alone]
            source = np.concatenate([source, *[np.array(x, np.uint32) for x in found]])
        total = np.cumsum(many)
        ids = source[np.arange(total[-1] if len(total) else 0) + np.repeat(at - total + many, many)]
        first = np.concatenate([[0], np.cumsum(np.bincount(row, many, len(text)).astype(np.int64))])
        if end_id is None:
            return ids, first
        out, place = np.empty(len(ids) + len(text), np.uint32), first + np.arange(len(first))
        last = np.zeros(len(out), bool)
        last[place[1:] - 1] = True
        out[last], out[~last] = end_id, ids
        return out, place

    def _parts(self, text: Bytes, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts begin, and the text of each. Texts marked whole are one part."""
        n = len(text.data)
        kind = KIND[text.data]
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        cut, inner = np.zeros(n + 1, bool), np.ones(n + 1, bool)  # inner: the mark before belongs to the same text
        inner[text.offsets] = False
        cut[1:n] = APART[pair]
        cut[: max(0, n - 1)] |= LAST[pair] & inner[1:n]
        cut[text.offsets] = True
        for i in np.flatnonzero(whole):
            cut[text.offsets[i] + 1 : text.offsets[i + 1]] = False
        start = np.flatnonzero(cut[:n])
        return start, np.searchsorted(text.offsets, start, side="right") - 1

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Encode distinct parts: words many to a text, told apart by the space or line feed before each; the rest one by one."""
        kind = np.array([0 if p[:1] == b" " and len(p) > 1 and not SPACE[p[1]] else 2 if SPACE[p[0]] else 1 for p in parts])
        order, found, lengths = [], [], []
        for mark, of in ((b" ", np.flatnonzero(kind == 0)), (b"\n", np.flatnonzero(kind == 1)), (b"", np.flatnonzero(kind == 2))):
            for i in range(0, len(of), BUNDLE if mark else 1):
                some = of[i : i + (BUNDLE if mark else 1)]
                given = b"".join(parts[j] if mark == b" " else mark + parts[j] for j in some)
                ids = np.array(self.ids([given.decode()])[0], np.uint32)
                many = np.array([len(ids)])
                if mark:
                    begin = np.flatnonzero(self.begins[mark][ids])
                    if len(begin) != len(some):
                        raise ValueError("the vocabulary does not cut text at white space")
                    many = np.diff(begin, append=len(ids))
                    if mark == b"\n":  # the line feed is a token of its own, which isn't the word's
                        ids, many = np.delete(ids, begin), many - 1
                order.append(some)
                found.append(ids)
                lengths.append(many)
        self.memo.add(keys[np.concatenate(order)], np.concatenate(found), np.concatenate(lengths))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def bounds(self, text: str) -> tuple[list[int], np.ndarray] | None:
        """ids, and where each token of text begins; then the end."""
        found = self.model.encode(text, add_special_tokens=False)
        at = np.array(found.offsets, np.int64).reshape(-1, 2)
        begins = at[:, 0].copy()
        begins[:1] = 0
        begins[1:] = np.minimum(begins[1:], np.maximum(at[:-1, 1], begins[:-1]))  # a space left out of the offsets belongs to the token after it
        return found.ids, np.append(begins, len(text))

    def stable(self, text: str, at: int) -> bool:
        """Nothing spans a single space between two marks other than white space, and no special string holds one."""
        return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace() and not any(" " in x for x in self.special)


class PieceEncoder:
    """The sentencepiece library, without begin or end."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        for i in range(self.size):
            if self.model.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.lengths[i] = value < 0x80 or value >= 0xC0  # one mark begins with each such byte
            elif self.model.is_control(i):
                self.lengths[i] = 0
            elif self.model.is_unknown(i):
                self.lengths[i] = -(1 << 40)  # of unknown length: offsets can't be told
        #: Marks that stand side by side inside a piece; merges can't cross any other pair.
        self.inside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def flat(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), with end_id after each; and where each text's begin, then the end."""
        found = [np.array(x if end_id is None else [*x, end_id], np.uint32) for x in self.ids([x or "" for x in column.to_pylist()])]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def bounds(self, text: str) -> tuple[list[int], np.ndarray] | None:
        ids = self.model.encode(text, num_threads=1)
        ends = np.cumsum(self.lengths[ids])
        if not len(ids) or ends[-1] != len(text) + 1:  # the text was changed before it was cut: offsets don't hold
            return None
        return ids, np.append(np.maximum(np.concatenate([[0], ends[:-1]]) - 1, 0), len(text))

    def stable(self, text: str, at: int) -> bool:
        pair = [x.replace(" ", "▁") for x in text[at - 1 : at + 1]]
        return len(pair) == 2 and pair[0].isprintable() and pair[1] == "▁" and tuple(pair) not in self.inside


@lru_cache(maxsize=4)
def encoder(name: str) -> JsonEncoder | PieceEncoder:
    path = vocabulary(name)
    return PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)


def batches(texts: list[str], chars: int = 1 << 20):
    """Slices (from, to) of about so many characters."""
    begin = total = 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
