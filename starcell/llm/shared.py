"""What the text operators share: Arrow texts, word hashes, unit caches, stored steps, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcell.session import write_and_read

# Bytes that one numpy step works on; temporaries are about ten times as large.
BLOCK_BYTES = 1 << 20

# Odd multipliers of 64-bit mixing.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)

# While a step is stored: its shuffle files go when it is done, as only what is stored is read
# later, and texts come to Python in small batches.
STEP_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                 "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def step_settings(spark: SparkSession):
    before = {name: spark.conf.get(name) for name in STEP_SETTINGS}
    for name, value in STEP_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again; its shuffle files go at once."""
    with step_settings(df.sparkSession):
        return write_and_read(df, name)


def text_mark() -> Column:
    """128 bits that tell apart rows that share a doc_id; rows with the same text have the same."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= MIX_B
    x ^= x >> np.uint64(27)
    x *= MIX_C
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, and where each starts; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not pa.types.is_large_binary(column.type):
        if pa.types.is_string(column.type):
            column = column.cast(pa.large_string())
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held, starts


def row_blocks(starts: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most `limit` bytes; a longer row is a range of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_blocks(data: np.ndarray, starts: np.ndarray,
                limit: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bounds, rows): consecutive ranges of `data` of about `limit` bytes in all, and the row of each.

    Short texts are whole ranges; a text of more than `limit` bytes comes in ranges that end
    before white space, so that no word is cut.
    """
    for i, j in row_blocks(starts, limit):
        at, end = int(starts[i]), int(starts[j])
        if j - i > 1 or end - at <= limit:
            yield starts[i:j + 1], np.arange(i, j)
            continue
        while at < end:
            to = min(at + limit, end)
            while to < end:
                found = np.flatnonzero(IS_SPACE[data[to:min(to + 4096, end)]])
                if len(found):
                    to += int(found[0])
                    break
                to = min(to + 4096, end)
            yield np.array([at, to]), np.array([i])
            at = to


# Words are runs of bytes that are neither space nor \t \n \v \f \r, which UTF-8
# never uses inside another character.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_KEYS = mixed(np.arange(1, 257, dtype=np.uint64) * MIX_A)


def powers(n: int, base: np.uint64 = MIX_A) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, and the text each is in.

    `starts` are the texts' bounds within `data`; a word never crosses them.
    """
    solid = ~IS_SPACE[data]
    if not solid.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    bounds = starts[:-1][starts[:-1] < starts[1:]]
    begins[bounds] = solid[bounds]
    first = np.flatnonzero(begins)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[bounds[1:] - 1] = solid[bounds[1:] - 1]
    last = np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(starts, first, "right") - 1


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [first, last), which follow each other."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    inside = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    at = np.arange(int(size.sum())) + inside
    places = at - np.repeat(first, size)
    value = _BYTE_KEYS[data[at]] * powers(int(size.max()))[places]
    total = np.add.reduceat(value, np.concatenate(([0], np.cumsum(size)[:-1])))
    return mixed(total + size.astype(np.uint64) * MIX_C)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each word on; len(words) - n + 1 of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for j in range(1, n):
        out *= MIX_A
        out += words[j:j + count]
        out ^= out >> np.uint64(29)
    return mixed(out)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b bigint): the smallest node reachable.

    Rounds of large-star and small-star, each stored. A star's centre is found by an
    aggregation with partial sums, and the join with it may split a hot centre, so no
    task and no driver holds a component.
    """
    def stars(links: DataFrame, large: bool) -> DataFrame:
        if large:
            both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        centre = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(centre, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                F.struct("a", F.col("m").alias("b")))).alias("e"))
                .select("e.*").where("a <> b"))

    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = stored(edges.where("a <> b").distinct(), f"{name}-links")
    seen = None
    while True:
        links = stored(stars(stars(links, True).distinct(), False).distinct(), f"{name}-links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left") \
        .select("node", F.coalesce("component", "node").alias("component"))
