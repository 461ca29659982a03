"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their classes.

Two sets with a Jaccard similarity of `percent` share at least T = ceil(percent * n / 100)
of either's n shingles (T-occurrence).

1. Equal sets become one node (a 128-bit fingerprint), by an aggregation.
2. The whole inverted index is built once, in packed postings, a bucket of shingles per
   task. Lists of one document end there. A document that is left with fewer than T lists
   can have no partner and leaves; of the others, all but the T - 1 longest lists are short.
   Lists that a bounded sample shows to be very long are never gathered: their postings are
   dealt by document, as their length only matters for the order.
3. Short lists tie their documents together, in the order of sizes, so that no pairs come
   out. What is tied together is a group, and its sets go to one task, or, for a large group,
   to one task for each pair of its blocks. There each set is a query: the short lists of the
   group are merged, and those found often enough are probed in the long lists by binary
   search (DivideSkip). Pairs that earlier links already connect are skipped.

The index keys are shortened hashes. Where two shingles or documents share one, a document
stays or is tied that need not be; links are decided on the sets alone. Of a document whose
own shingles share keys, T is lowered by the keys it lacks.

Classes are the connected components of the links, found by stored rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcell.llm.shared import (LOWER, components, gram_hashes, mixed, row_blocks, run_hashes, stored,
                                 text_bytes, text_mark, words_of)

SHINGLE = 5
PERCENT = 75
# Documents, as expected, whose shingles show which lists are very long.
SAMPLE_DOCS = 4000
# Sampled documents that a very long list has at least, and the parts it is tied in.
LONG_FROM = 12
SPLITS = 64
# Documents whose postings are packed together.
PACKED_DOCS = 1000
# Buckets of postings for each shuffle partition.
BUCKETS = 8
# Blocks that a group is cut into before they grow, their size until then, and after it.
BLOCKS = 20
BLOCK_ROWS = 128
MOST_BLOCK_ROWS = 2048

# A posting: list key, document (48 bits of its node), size code, how many keys fewer than shingles
# the document has (MANY stands for that or more), and the list's length once known.
ENTRY = np.dtype([("key", "<u8"), ("node", "<u8"), ("size", "<u2"), ("lacks", "u1"), ("length", "<u4")])
MANY = 255
_LONG = np.uint64(1 << 62)
_SIZE_STEP = 2000

SETS = "doc_id bigint, mark binary, n_shingles bigint, node binary"
PACKED = "bucket int, entries binary"
MEMBERS = "grp bigint, one int, two int, block int, node binary, shingles binary"


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each of some texts."""
    for i, j in row_blocks(starts):
        part, bounds = LOWER[data[starts[i]:starts[j]]], starts[i:j + 1] - starts[i]
        first, last, owner = words_of(part, bounds)
        words = run_hashes(part, first, last)
        ends = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            own = words[ends[k]:ends[k + 1]]
            if len(own) >= size:
                yield np.unique(gram_hashes(own, size))
            else:   # the whole short sequence is one shingle
                yield mixed(gram_hashes(own, len(own)) + np.uint64(len(own))) if len(own) else own


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set: two sums of differently mixed members."""
    one = mixed(shingles + np.uint64(1)).sum(dtype=np.uint64)
    two = mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.array([one, two], ">u8").tobytes()


def short_nodes(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b"\0\0" + n[:6] for n in nodes), ">u8").astype(np.uint64)


def size_code(n: int) -> int:
    """A size in 16 bits: exact up to 32768, then rounded down by less than 0.04 percent."""
    return n if n <= 32768 else 32768 + int(np.log2(n / 32768) * _SIZE_STEP)


def size_of(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code <= 32768, code, np.floor(32768 * 2.0 ** ((code - 32768) / _SIZE_STEP)).astype(np.int64) - 1)


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(*text_bytes(batch.column("text")), size))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in found], pa.int64()),
             pa.array([fingerprint(s) if len(s) else None for s in found], pa.binary())],
            ["doc_id", "mark", "n_shingles", "node"])


def _sampled(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in shingle_sets(*text_bytes(batch.column("text")), size):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["shingle"])


def _rows(bucket: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """Arrays of postings as one row per bucket."""
    by = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[by], entries[by]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    begins, ends = np.concatenate(([0], cuts)), np.append(cuts, len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begins].astype(np.int32)),
         pa.array([entries[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())], ["bucket", "entries"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Each bucket with all its postings; the input is sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for number, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
            if number != bucket and held:
                yield bucket, b"".join(held)
                held = []
            bucket = number
            held.append(entries)
    if held:
        yield bucket, b"".join(held)


def _postings(size: int, long: np.ndarray, buckets: int,
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All postings in 12 bytes: 3 of the shingle, 6 of the document, 2 of its size, 1 of what it lacks.

    Those of very long lists hold the list's number, in buckets after the others.
    """
    def packed(held: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        lengths = [len(x) for x in held.values()]
        keys = np.concatenate(list(held.values()))
        nodes = np.repeat(short_nodes(list(held)), lengths)
        code = np.repeat(np.array([size_code(n) for n in lengths], np.uint16), lengths)
        hashed = mixed(keys.copy())
        bucket, short = hashed % np.uint64(buckets), hashed // np.uint64(buckets) & np.uint64(0xFFFFFF)
        if len(long):
            at = np.minimum(np.searchsorted(long, keys), len(long) - 1)
            known = long[at] == keys
            bucket = np.where(known, np.uint64(buckets) + nodes % np.uint64(buckets), bucket)
            short = np.where(known, at.astype(np.uint64), short)
        ends = np.cumsum(lengths)
        own = bucket << np.uint64(24) | short
        lacks = [n - len(np.unique(own[e - n:e])) for e, n in zip(ends, lengths)]
        lacks = np.repeat(np.minimum(lacks, MANY).astype(np.uint8), lengths)
        entries = np.concatenate((short.view(np.uint8).reshape(-1, 8)[:, :3],
                                  nodes.view(np.uint8).reshape(-1, 8)[:, :6], code.view(np.uint8).reshape(-1, 2),
                                  lacks.reshape(-1, 1)), 1)
        return _rows(bucket.astype(np.int64), entries)

    for batch in batches:
        held: dict[bytes, np.ndarray] = {}
        for s in shingle_sets(*text_bytes(batch.column("text")), size):
            if len(s):
                held.setdefault(fingerprint(s), s)
            if len(held) >= PACKED_DOCS:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)


def _lists(counts: np.ndarray, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of lists with several documents, with the lists' lengths, dealt by document."""
    ready, held = [], 0
    for bucket, packed in _gathered(batches):
        raw = np.frombuffer(packed, np.uint8).reshape(-1, 12)
        wide = np.zeros((len(raw), 2, 8), np.uint8)
        wide[:, 0, :3], wide[:, 1, :6] = raw[:, :3], raw[:, 3:9]
        key, node = np.ascontiguousarray(wide.view("<u8")[:, :, 0]).T
        code = np.ascontiguousarray(raw[:, 9:11]).view("<u2")[:, 0]
        lacks = raw[:, 11]
        by = np.lexsort((node, key))
        key, node, code, lacks = key[by], node[by], code[by], lacks[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, code, lacks = key[new], node[new], code[new], lacks[new]
        out = np.zeros(len(key), ENTRY)
        if bucket >= buckets:
            out["length"] = counts[key.astype(np.int64)]
            key = key | _LONG
        else:
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out["length"] = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
            key = key | np.uint64(bucket << 24)
        out["key"], out["node"], out["size"], out["lacks"] = key, node, code, lacks
        out = out[out["length"] > 1]
        ready.append(out)
        held += len(out)
        if held >= 1 << 19:
            out = np.concatenate(ready)
            yield _rows((mixed(out["node"].copy()) % np.uint64(buckets)).astype(np.int64), out)
            ready, held = [], 0
    if held:
        out = np.concatenate(ready)
        yield _rows((mixed(out["node"].copy()) % np.uint64(buckets)).astype(np.int64), out)


def _short_lists(percent: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with T lists or more, the postings in all but their T - 1 longest lists, dealt by list."""
    for _, packed in _gathered(batches):
        e = np.frombuffer(packed, ENTRY)
        e = e[np.lexsort((e["key"], e["length"], e["node"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["node"][1:] != e["node"][:-1]) | (e["key"][1:] != e["key"][:-1])
        e = e[new]
        first = np.flatnonzero(np.concatenate(([True], e["node"][1:] != e["node"][:-1])))
        count = np.diff(np.append(first, len(e)))
        lacks = e["lacks"][first].astype(np.int64)
        short = count - (-(-percent * size_of(e["size"][first]) // 100) - lacks) + 1
        short = np.where(lacks == MANY, count, np.minimum(short, count))
        e = e[np.arange(len(e)) - np.repeat(first, count) < np.repeat(short, count)]
        if len(e):
            part = np.where(e["key"] >= _LONG, e["node"] % np.uint64(SPLITS), np.uint64(0))
            yield _rows((mixed(e["key"] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets))
                        .astype(np.int64), e)


class Forest:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def list_ties(e: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the documents of each list together, where sizes allow a link.

    Parts of a very long list are also tied to a node made from its key.
    """
    size = size_of(e["size"])
    by = np.lexsort((e["node"], size, e["key"]))
    keys, nodes, size = e["key"][by], e["node"][by], size[by]
    near = (keys[1:] == keys[:-1]) & (1001 * size[:-1] >= 10 * percent * size[1:])
    heads = keys >= _LONG
    heads[1:] &= ~near
    marks = mixed(keys[heads] + np.uint64(5)) >> np.uint64(2) | _LONG
    return np.concatenate((nodes[:-1][near], nodes[heads])), np.concatenate((nodes[1:][near], marks))


def _ties(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, packed in _gathered(batches):
        a, b = list_ties(np.frombuffer(packed, ENTRY), percent)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        # Only what connects: a tree of each tied set.
        names, places = np.unique(pairs, return_inverse=True)
        forest = Forest(len(names))
        for x, y in places.reshape(-1, 2).tolist():
            forest.join(x, y)
        roots = np.array([forest.root(x) for x in range(len(names))], np.int64)
        kept = roots != np.arange(len(names))
        names = names.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[roots[kept]]), pa.array(names[kept])], ["a", "b"])


def _members(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set for each pair of blocks that it belongs to."""
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(*text_bytes(batch.column("text")), size)]
        for i in range(0, batch.num_rows, 200):
            part = batch.slice(i, 200)
            count = part.column("blocks").to_numpy()
            row = np.repeat(np.arange(part.num_rows), count)
            other = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            block = part.column("block").to_numpy()[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("grp").take(take), pa.array(np.minimum(block, other).astype(np.int32)),
                 pa.array(np.maximum(block, other).astype(np.int32)), pa.array(block.astype(np.int32)),
                 part.column("node").take(take), pa.array(sets[i:i + 200], pa.binary()).take(take)],
                ["grp", "one", "two", "block", "node", "shingles"])


def linked(sets: list[np.ndarray], blocks: list[int], percent: int) -> Forest:
    """Links among sets (in ascending order of size), between two blocks if there are two."""
    sizes = np.array([len(s) for s in sets])
    blocks = np.array(blocks)
    two = blocks.min() != blocks.max()
    names, places = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    mine = [places[e - n:e] for e, n in zip(ends, sizes)]      # sorted, as the hashes are
    by = np.argsort(places, kind="stable")
    lists, begin = owner[by], np.searchsorted(places[by], np.arange(len(names) + 1))
    length = np.diff(begin)
    forest = Forest(len(sets))
    for x in range(1, len(sets)):
        low = int(np.searchsorted(100 * sizes, percent * sizes[x], "left"))
        if low >= x:
            continue
        least = needed(int(sizes[x]), percent)
        own = mine[x]
        own = own[np.argsort(length[own], kind="stable")]
        longest = int(length[own[-1]])
        skipped = min(least - 1, int(least / (0.0085 * np.log2(max(2, longest)) + 1)))
        short, long = own[:len(own) - skipped], np.sort(own[len(own) - skipped:])
        short = short[length[short] > 1]
        if not len(short):
            continue
        found = np.concatenate([lists[begin[s]:begin[s + 1]] for s in short.tolist()])
        times = np.bincount(found[(found >= low) & (found < x)], minlength=x)
        enough = np.flatnonzero(times >= least - skipped)
        if two:
            enough = enough[blocks[enough] != blocks[x]]
        for y in enough[np.argsort(-times[enough], kind="stable")].tolist():
            if forest.root(x) == forest.root(y):
                continue
            at = np.searchsorted(mine[y], long)
            at[at == len(mine[y])] = 0
            both = int(times[y]) + int((mine[y][at] == long).sum())
            if 100 * both >= percent * (int(sizes[x]) + int(sizes[y]) - both):
                forest.join(x, y)
    return forest


def _links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def links(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: (len(r[2]), r[1]))
        forest = linked([np.frombuffer(r[2], "<u8") for r in rows], [r[0] for r in rows], percent)
        ends = [(rows[forest.root(x)][1], rows[x][1]) for x in range(len(rows)) if forest.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], ["a", "b"])

    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("grp", "one", "two", "block", "node", "shingles")]
        for grp, one, two, block, node, shingles in zip(*columns):
            if (grp, one, two) != key and held:
                if len(held) > 1:
                    yield links(held)
                held = []
            key = (grp, one, two)
            held.append((block, node, shingles))
    if len(held) > 1:
        yield links(held)


def _long_lists(texts: DataFrame, size: int, documents: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a bounded sample have, and their expected list lengths."""
    share = min(1.0, sample / max(1, documents))
    part = texts.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most as many as the sampled documents have shingles, over LONG_FROM; keys and counts go to all tasks.
    found = (part.select("text").mapInArrow(partial(_sampled, size), "shingle bigint")
             .groupBy("shingle").count().where(F.col("count") >= LONG_FROM).toPandas())
    keys = found["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(keys)
    counts = np.minimum(found["count"].to_numpy()[by] / share, 2**32 - 1).astype(np.uint32)
    return keys[by][:1 << 24], counts


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, mark, n_shingles, node, component and component_id.

    `node` names a distinct set, `mark` the text, `component` (a node) the class; component_id
    is the smallest doc_id reachable by links, which classes share where ids are null or used again. Null and empty texts, or such without words, have no shingles and
    link with nothing, so that their component is their own doc_id. Repeated rows, and any
    with equal sets, are in one class; a class whose ids are all null has a null id. An
    empty table gives an empty result, and other columns are ignored.
    """
    if not (1 <= percent <= 100 and size >= 1):
        raise ValueError("percent lies in 1..100, and a shingle has a word at least")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        text_mark().alias("mark"), "text")
    sets = stored(texts.mapInArrow(partial(_sets, size), SETS), "jaccard-sets")
    long, counts = _long_lists(texts, size, sets.count(), sample)
    nodes = stored(sets.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "mark")).alias("at"), F.min("doc_id").alias("least")), "jaccard-nodes")

    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = texts.mapInArrow(partial(_postings, size, long, buckets), PACKED)
    for step in (partial(_lists, counts, buckets), partial(_short_lists, percent, buckets)):
        entries = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(step, PACKED)
    ties = stored(entries.repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(partial(_ties, percent), "a bigint, b bigint"), "jaccard-ties")
    groups = stored(components(ties, "jaccard-groups"), "jaccard-groups")

    # A node's first bytes are its name among the ties.
    name = F.conv(F.hex(F.substring("node", 1, 6)), 16, 10).cast("bigint")
    grouped = nodes.select("node", "at", name.alias("name")).join(
        groups.select(F.col("node").alias("name"), F.col("component").alias("grp")), "name")
    counts = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.greatest(F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS)), F.ceil(F.col("n") / MOST_BLOCK_ROWS))
    wanted = (grouped.join(counts.select("grp", blocks.cast("int").alias("blocks")), "grp")
              .select("at.doc_id", "at.mark", "node", "grp", "blocks",
                      F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
              .withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"}))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark"))
    members = texts.join(wanted, same).select("text", "node", "grp", "blocks", "block") \
        .mapInArrow(partial(_members, size), MEMBERS)
    links = stored(members.repartition("grp", "one", "two").sortWithinPartitions("grp", "one", "two")
                   .mapInArrow(partial(_links, percent), "a binary, b binary"), "jaccard-links")

    found = stored(components(links, "jaccard-classes"), "jaccard-classes")
    named = nodes.select("node", "least").join(found, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "component").select("node", "component", "component_id"), "jaccard-names")
    return sets.join(named, "node", "left").select(
        "doc_id", "mark", "n_shingles", "node", "component",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, in the columns of `docs`.

    Of rows that share that id the one with the smallest text mark stays, of equal rows one
    of them. Documents without shingles all stay. Names that start with two underscores are reserved.
    """
    found = stored(classes(docs, size, percent), "jaccard-kept")
    first = found.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("at"))
    kept = (found.where("n_shingles = 0").select("doc_id", "mark", F.lit(False).alias("one"))
            .union(first.select("at.doc_id", "at.mark", F.lit(True))).distinct()
            .select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"), F.col("one").alias("__one")))
    names = [f"`{c}`" for c in docs.columns]
    held = docs.withColumns({"__key": F.col("doc_id").cast("bigint"),
                             "__its": text_mark()})
    same = F.col("__key").eqNullSafe(F.col("__doc")) & (F.col("__its") == F.col("__mark"))
    held = held.join(kept, same)
    if not found.where("n_shingles > 0").groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        # Equal rows cannot be told apart: one of each stays, but for those without shingles.
        once = held.where("__one").dropDuplicates(["__key", "__its"])
        held = once.union(held.where("not __one"))
    return held.select(*names)
