"""Token ids as fixed-width bit-packed blocks.

The file format: a folder of Parquet files as the container, so that Spark's commit
protocol covers retries and any file system works, and in it one row per block. A block
holds whole documents: their ids, each in the fewest bits the vocabulary needs, their
doc_ids and their ends within the block, and the block's place in the stream of all ids.
An id's bits lie at `position * bits`, so one numpy step unpacks any slice of a block, and
a range of the stream is found through the blocks' places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starcell.llm.encoding import encoder
from starcell.llm.shared import step_settings

# Ids after which a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 17
# Characters whose ids are made in one go.
CALL_CHARS = 8_000_000

BLOCK_SCHEMA = ("part int, block int, part_start bigint, n_ids bigint, bits int, "
                "doc_ids array<bigint>, ends array<bigint>, payload binary")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, the lowest bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    table = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(table.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids [first, first + count) of packed bits, touching only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    low = first * bits // 8
    held = np.frombuffer(payload[low:((first + count) * bits + 7) // 8] + bytes(8), np.uint8)
    at = np.arange(first, first + count, dtype=np.int64) * bits - low * 8
    words = np.ndarray(len(held) - 7, np.dtype("<u8"), held, 0, (1,))
    ids = words[at >> 3] >> (at & 7).astype(np.uint64)
    return (ids & np.uint64((1 << bits) - 1)).astype(np.uint32)


def id_batches(texts: list[str], own, end_id: int | None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Ids of texts, a bounded number of characters at a time, with where the slice starts."""
    first = 0
    tail = np.array([] if end_id is None else [end_id], "<u4")
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= CALL_CHARS):
            held += len(texts[last])
            last += 1
        yield first, [np.concatenate((ids, tail)) for ids in own.encode(texts[first:last])]
        first = last


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0,
          block_ids: int = BLOCK_IDS) -> None:
    """Encode `text` of every row, append `end_id`, and write the ids in ascending `doc_id` order.

    Rows are range-partitioned by doc_id (and, for equal ones, by a hash of the text, so
    that no id is too hot), sorted, and encoded in order; each partition becomes one part.
    A null text is empty, a null doc_id sorts first, repeated rows are all written, and an
    empty table makes an empty folder. Other columns are not written.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        bits = bits_for(max(own.library.get_vocab_size(), (end_id or 0) + 1))
        part, place, number = TaskContext.get().partitionId(), 0, 0
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            joined = np.concatenate(ids)
            ends = np.cumsum([len(x) for x in ids])
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([place], pa.int64()),
                pa.array([len(joined)], pa.int64()), pa.array([bits], pa.int32()),
                pa.array([names], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())),
                pa.array([pack_bits(joined, bits)], pa.binary())],
                ["part", "block", "part_start", "n_ids", "bits", "doc_ids", "ends", "payload"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, coded in id_batches(texts, own, end_id):
                for key, x in zip(keys[first:], coded):
                    names.append(key)
                    ids.append(x)
                    held += len(x)
                    if held >= block_ids:
                        yield block()
                        place, number, names, ids, held = place + held, number + 1, [], [], 0
        if names:
            yield block()
        own.rest()

    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
            .repartitionByRange(*order).sortWithinPartitions(*order))
    with step_settings(docs.sparkSession):
        rows.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks with `start`, the ids of the stream before them; one row per part is put in order."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    # There are as many parts as the write had partitions, a number that the session sets.
    return (stored.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("part_start"))
            .drop("before", "part_start"))


def documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], row["bits"], 0, row["n_ids"])
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                sums = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(begins, ends)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + begins),
                           pa.array(ends - begins), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(begins, ends[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return blocks(spark, path).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def stream_slice(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """Ids [first, first + count) of the stream as (start, ids), unpacking only their bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = max(0, first - row["start"])
                high = min(row["n_ids"], first + count - row["start"])
                ids = unpack_bits(row["payload"], row["bits"], low, high - low).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["start"] + low], pa.int64()), pa.array([ids], pa.list_(pa.int32()))],
                    ["start", "ids"])

    wanted = blocks(spark, path).where((F.col("start") < first + count)
                                       & (F.col("start") + F.col("n_ids") > first))
    return wanted.select("start", "n_ids", "bits", "payload").mapInArrow(run, "start bigint, ids array<int>")
