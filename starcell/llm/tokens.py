"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A text longer than a chunk is encoded chunk by chunk, each with some text before and
after it. Two neighbours are spliced inside their overlap, at a boundary that is proven
stable: between two characters that no piece of the vocabulary holds next to each other,
so that no merge can ever cross it. Both encodings must have a token boundary there; when
the overlap has no such place, or the two disagree, it is widened, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
# Texts that one call of the library takes, and the characters after which a call is made.
CALL_CHARS = 4_000_000

SPACE = "▁"


class Counter:
    """Counts with one SentencePiece model (a local file on every worker)."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.inner = set()
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)):
                self.inner.update(zip(piece, piece[1:]))

    def stable(self, text: str, low: int, high: int) -> Iterator[int]:
        """Places in (low, high), from the middle outwards, that no merge can cross."""
        middle = (low + high) // 2
        for step in range(high - low):
            at = middle + (step // 2 if step % 2 else -(step // 2))
            if low < at < high:
                pair = tuple(SPACE if c == " " else c for c in text[at - 1:at + 1])
                if pair not in self.inner:
                    yield at

    def boundaries(self, text: str, first: int, last: int) -> np.ndarray:
        """Where, in characters of `text`, tokens of text[first:last] start, with repeats for bytes."""
        part = text[first:last]
        pieces = self.model.encode(part, return_type="proto").pieces
        ends = np.cumsum([len(c.encode()) for c in part])
        begins = np.fromiter((p.begin for p in pieces), np.int64, len(pieces))
        # Bytes of one character carry its start, all but the last with an empty range.
        return first + np.searchsorted(ends, begins, "right")

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.model.encode(text))
        total, first = 0, 0     # tokens before `first`, which is 0 or a splice
        before = 0              # where the chunk's encoding starts
        while True:
            last = first + self.chunk
            if last + self.overlap >= len(text):
                starts = self.boundaries(text, before, len(text))
                return total + int((starts >= first).sum())
            width = self.overlap
            while True:
                low, high = max(first, last - width), min(len(text), last + width)
                here = self.boundaries(text, before, high)
                there = self.boundaries(text, low, min(len(text), high + width))
                cut = next((at for at in self.stable(text, low, high)
                            if at in here and at in there), None)
                if cut is not None or high == len(text):
                    break
                width *= 2
            if cut is None:     # no place to splice up to the end of the text
                return total + int((here >= first).sum())
            total += int(((here >= first) & (here < cut)).sum())
            before, first = low, cut


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, model: str, limit: int, chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Adds `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens) to rows with a `text`.

    Null and empty texts have 0 bytes and 0 tokens. Rows are counted one by one in the
    task that reads them, so repeated rows count alike, an empty table gives an empty
    one, and nothing is shuffled. Columns of the input with the added names are replaced.
    Python holds one chunk's tokens of a huge text at a time.
    """
    added = ("n_bytes", "n_tokens", "over_limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = np.zeros(len(texts), np.int64)
            short, held = [], 0
            for i, text in enumerate(texts):
                if len(text) > own.chunk:
                    counts[i] = own.count(text)
                    continue
                short.append(i)
                held += len(text)
                if held >= CALL_CHARS:
                    counts[short] = [len(e) for e in own.model.encode([texts[k] for k in short], num_threads=1)]
                    short, held = [], 0
            if short:
                counts[short] = [len(e) for e in own.model.encode([texts[k] for k in short], num_threads=1)]
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                [*batch.schema.names, *added])

    docs = docs.drop(*added)
    schema = StructType(list(docs.schema.fields)).add("n_bytes", "long").add("n_tokens", "long")
    return docs.mapInArrow(run, schema.add("over_limit", "boolean"))
