"""Token counts: long documents in overlapping chunks, spliced where both chunks have a boundary that is proven stable.

Method. Texts of up to chunk characters are encoded as they are. A longer one is cut into chunks that overlap. A position is
proven stable if the vocabulary can't span it: no piece has those two marks side by side (sentencepiece), or the rule that
splits text before the merges always cuts there (tokenizers). Whatever lies on one side can't change the tokens of the other.
Two chunks are spliced at the last stable position in their overlap at which both begin a token. Without one the overlap is
widened, at last to the whole earlier chunk, which then is encoded together with the next. Only where a vocabulary changes text
before it cuts it, so that offsets don't hold, is a long text encoded as a whole (n_splices 0).

Defined results. A null text is empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each. Other columns are left
out. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomdoc.llm.encoders import batches, encoder


def spliced(coder, text: str, chunk: int, overlap: int) -> tuple[list[int], int]:
    """The ids of text, as coder gives them for the whole, from chunks; and at how many places they were spliced."""
    done: list[int] = []
    splices = 0
    begin, end, at_done = 0, min(len(text), chunk), 0  # what stands before at_done is done; a stable position
    head = coder.bounds(text[begin:end])
    while head is not None:
        ids, at = head
        skip = int(np.searchsorted(at, at_done - begin))
        if end == len(text):
            return done + list(ids[skip:]), splices
        reach, joined = overlap, None
        while joined is None and end - reach > at_done:
            start, stop = end - reach, min(len(text), end + chunk)
            tail = coder.bounds(text[start:stop])
            if tail is None:
                return list(coder.ids([text])[0]), 0
            both = np.intersect1d(at[skip + 1 : -1] + begin, tail[1][1:-1] + start)[::-1]
            joined = next((int(p) for p in both if p > start and coder.stable(text, int(p))), None)
            reach *= 2
        if joined is None:  # no alignment: this chunk grows to take in the next
            end = min(len(text), end + chunk)
            head = coder.bounds(text[begin:end])
        else:
            done += ids[skip : int(np.searchsorted(at, joined - begin))]
            begin, end, at_done, head = start, stop, joined, tail
            splices += 1
    return list(coder.ids([text])[0]), 0


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, chunk: int = 1 << 12, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_splices of each document (doc_id, text).

    vocabulary: a .json or .model file, by path or name. chunk, overlap: in characters.
    """

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for frame in frames:
            texts = [x or "" for x in frame.column(1).to_pylist()]
            tokens, splices = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk]
            for a, b in batches([texts[i] for i in short]):
                tokens[short[a:b]] = [len(x) for x in coder.ids([texts[i] for i in short[a:b]])]
            for i, x in enumerate(texts):
                if len(x) > chunk:
                    ids, splices[i] = spliced(coder, x, chunk, overlap)
                    tokens[i] = len(ids)
            n_bytes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([frame.column(0), n_bytes, pa.array(tokens), pa.array(tokens > limit), pa.array(splices)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_splices"])

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_splices long")
