"""Best-fit packing: documents' pieces into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open, and a bitset has a bit for
every free space that some open bin has. A piece goes where the least space would be left:
the lowest set bit at or above its length. If none fits and no more bins may be open, the
fullest one, the lowest set bit of all, closes first. Each task packs the pieces of the
rows it reads as they come, in memory for the open bins alone.

The bins that are open when a task ends are taken apart: their pieces, rows of a few
numbers, are dealt over as few tasks as hold them and packed again, longest first. So
the tails of all tasks are joined, and a table of any number of files packs alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcell.llm.encoding import encoder
from starcell.llm.idfiles import id_batches
from starcell.plans.sizing import broadcast_if_small
from starcell.session import write_and_read

LENGTH = 2048
OPEN_BINS = 1024
# Sequences of a task are numbered below this many bits, its partition above them.
NUMBER_BITS = 33
# Sequences made of tails have this bit.
TAIL = 1 << 61
# A task that joins tails takes about this many sequences' worth of ids, and this many pieces, at most.
TAIL_BINS, TAIL_PIECES = 64 * OPEN_BINS, 1_000_000

SCHEMA = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
          "sequence_id bigint, offset bigint")


class Bins:
    """Open bins of one task; `place` returns (bin number, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return number

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, number = self.capacity, self.made
            self.made += 1
            self.open += 1
        if free == size:
            self.open -= 1
        else:
            self.by_free.setdefault(free - size, []).append(number)
            self.bits |= 1 << (free - size)
        return number, self.capacity - free


    def left_open(self) -> list[int]:
        return [number for bins in self.by_free.values() for number in bins]


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces: all full but, for a longer document, the first."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *[(at, length) for at in range(first, n, length)]]


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(NAMES, columns)], NAMES)


def _joined_tails(tails: DataFrame, length: int, open_bins: int) -> DataFrame:
    """Pieces packed anew, longest first; each keeps all but its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(length, open_bins), TAIL | TaskContext.get().partitionId() << NUMBER_BITS
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            kept = [batch.column(n) for n in NAMES[:5]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([base + number for number, _ in places], pa.int64()),
                 pa.array([offset for _, offset in places], pa.int64())], NAMES)

    size = tails.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("ids"), F.count(F.lit(1)).alias("rows")).first()
    parts = 1 + max(size["ids"] // (TAIL_BINS * length), size["rows"] // TAIL_PIECES)
    # A place is held by one piece, so parts are even, and a retried task sees the same rows in the same order.
    dealt = tails.repartition(int(parts), "sequence_id", "offset")
    return dealt.sortWithinPartitions(F.desc("length"), "sequence_id", "offset").mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0,
         open_bins: int = OPEN_BINS) -> DataFrame:
    """Where each piece of each document's ids goes: one row per piece (`SCHEMA`).

    Ids are those of the `tokenizers` file without special tokens, then `end_id`, so that a
    null or empty text is one piece of one id. Repeated rows are packed as often as they
    come, with their doc_id (null too); an empty table gives an empty one; other columns
    are ignored. A very long text is encoded stretch by stretch, and its ids (four bytes each) are
    in memory while its pieces are placed. Places are stored before tails are joined, so a
    repeated task moves no piece.
    """
    if length < 1 or open_bins < 1:
        raise ValueError("length and open_bins start from 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins = encoder(tokenizer), Bins(length, open_bins)
        base = TaskContext.get().partitionId() << NUMBER_BITS
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for first, coded in id_batches(texts, own, end_id):
                for key, ids in zip(keys[first:], coded):
                    for piece, (start, size) in enumerate(pieces(len(ids), length)):
                        number, offset = bins.place(size)
                        rows.append((key, piece, start, size, zlib.crc32(ids[start:start + size].tobytes()),
                                     base + number, offset))
            yield _batch(rows)
        # Bins that are still open, as rows without a piece.
        yield _batch([(None, None, None, None, None, base + number, None) for number in bins.left_open()])
        own.rest()

    placed = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)
    placed = write_and_read(placed, "placed")
    opened = broadcast_if_small(placed.where("piece is null").select("sequence_id"))
    held = placed.where("piece is not null")
    closed = held.join(opened, "sequence_id", "left_anti").select(*NAMES)
    tails = held.join(opened, "sequence_id", "left_semi").select(*NAMES)
    return closed.unionByName(_joined_tails(tails, length, open_bins))
