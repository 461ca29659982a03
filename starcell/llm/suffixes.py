"""Suffix-array dedup: the bytes covered by a string of fixed length that starts twice or more.

A suffix array limited to `length` bytes would order all suffixes by that many bytes, most
significant digit first, and the equal groups are the repeated strings. Shuffling an entry
per byte would move sixteen times the input, so the passes here take digits in an order that
lets most suffixes drop out early, and treat suffixes that stay neighbours together:

1. The first digit of a string is not its first bytes but the least (by hash) of the
   `digit` bytes long substrings in it. Equal strings have the same one at the same place.
   Consecutive suffixes that share their first digit form a run, so that a text has one
   entry for some seventy bytes. Runs whose first digit occurs once leave.
2. The second digit is the whole stretch that a run's strings cover. Runs with an equal one
   are repeated with all their strings; runs that are alone with theirs go on.
3. The last digits order the single strings of the remaining runs (at the edges of what was
   copied), pass by pass, among the runs of one first digit. A run's strings all hold its
   first digit, so what the repeated ones cover is one stretch, from the first of them to
   the end of the last.

The first two passes are aggregations with partial sums, and the joins back to runs may
split hot keys. The last ones sort the runs of a first digit in one task as long as those
are few. Many different runs of a first digit are cut into cells of neighbouring strings, whose
common bytes and whose whole bytes are two more digits, counted by aggregations; cells that
these leave open are halved, pass by pass, down to single strings. Digits are 64-bit hashes, refined pass by pass: a second digit only counts within
its first, and single strings agree in all digits that cover them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcell.llm.shared import BLOCK_BYTES, MIX_A, MIX_B, MIX_C, mixed, stored, text_bytes, text_mark

LENGTH = 200

_PLACE = np.uint64((1 << 24) - 1)
# Strings of a longer text that are handled together.
PIECE = 1 << 20

RUNS = "doc_id bigint, mark binary, low int, size int, digit bigint, stretch bigint"
CUTS = "doc_id bigint, mark binary, low int, again boolean, digit bigint, hot boolean, bytes binary"
EDGES = "doc_id bigint, mark binary, begin int, end int"
CELLS = ("doc_id bigint, mark binary, run int, low int, skip int, count int, again boolean, digit bigint, cell int, "
         "core bigint, whole bigint, bytes binary")
# Strings of a cell at first; cells are counted from the first digit, so that equal strings lie in equal ones.
CELL = 8
# Different runs of one first digit whose strings are sorted in one task, and rows sorted together.
HOT_RUNS = 256
SORTED_ROWS = 8192


def digit_width(length: int) -> int:
    """Bytes of the first digit: 8, doubled while it stays below two fifths of the string."""
    if length < 16:
        raise ValueError("strings of fewer than 16 bytes are not supported")
    width = 8
    while width * 5 <= length * 2:
        width *= 2
    return width if width * 5 <= length * 2 or width == 8 else width // 2


def digits(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the `width` bytes from each place on."""
    words = np.ndarray(len(data) - 7, np.dtype("<u8"), np.ascontiguousarray(data), 0, (1,))
    out = mixed(words + MIX_A)
    span = 8
    while span < width:
        joined = out[:-span] * MIX_A
        joined ^= out[span:]
        joined ^= joined >> np.uint64(32)
        joined *= MIX_B
        joined ^= joined >> np.uint64(29)
        out, span = joined, span * 2
    return out


def least_places(keys: np.ndarray, window: int) -> np.ndarray:
    """For each window of keys, the place of its least one, the first of equal ones."""
    least = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        rest = window - span
        least = np.minimum(least[:-rest], least[rest:])
    return (least & _PLACE).astype(np.int64)


def spans_hash(keys: np.ndarray, width: int, begin: np.ndarray, size: np.ndarray,
               seed: np.uint64 = MIX_C) -> np.ndarray:
    """Hashes of byte ranges of at least `width`, from the keys at every `width` bytes and at the end."""
    out = mixed(size.astype(np.uint64) + seed)
    for step in range(-(-int(size.max()) // width) if len(size) else 0):
        at = begin + np.minimum(step * width, size - width)
        out *= MIX_A
        out ^= keys[at]
        out ^= out >> np.uint64(31)
        out *= MIX_B
    return mixed(out)


def blocks(starts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least `length` bytes (row, first byte, last byte), many short or one piece of a long one."""
    sizes = np.diff(starts)
    held: list[tuple[int, int, int]] = []
    for row in np.flatnonzero(sizes >= length):
        low, high = int(starts[row]), int(starts[row + 1])
        if high - low > PIECE + length:
            for at in range(low, high - length + 1, PIECE):
                yield tuple(np.array([x]) for x in (row, at, min(at + PIECE + length - 1, high)))
            continue
        if held and high - held[0][1] > BLOCK_BYTES:
            yield tuple(np.array(x) for x in zip(*held))
            held = []
        held.append((int(row), low, high))
    if held:
        yield tuple(np.array(x) for x in zip(*held))


def block_runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, width: int):
    """Runs of the texts data[first:last]: text index, first start, number of starts, both digits."""
    base = int(first[0])
    part = data[base:int(last[-1])]
    keys = digits(part, width)
    place = least_places(keys, length - width + 1)
    cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
    low = np.unique(np.concatenate(([0], cuts, first - base)))
    low = low[low < len(place)]
    high = np.append(low[1:], len(place))               # exclusive, in starts
    text = np.searchsorted(first - base, low, "right") - 1
    high = np.minimum(high, last[text] - base - length + 1)
    good = high > low
    low, high, text = low[good], high[good], text[good]
    size = high - low + length - 1
    return text, low + base, size, keys[place[low]], spans_hash(keys, width, low, size)


def _runs(length: int):
    width = digit_width(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for rows, first, last in blocks(starts, length):
                text, low, size, digit, stretch = block_runs(data, first, last, length, width)
                row = rows[text]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), marks.take(pa.array(row)),
                     pa.array((low - starts[row]).astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(digit.view(np.int64)), pa.array(stretch.view(np.int64))],
                    ["doc_id", "mark", "low", "size", "digit", "stretch"])

    return run


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for, cut out of their texts, and of equal rows out of one per task."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()))
        new = [key not in seen and not seen.add(key) for key in keys]
        if not any(new):
            continue
        batch = batch.filter(pa.array(new))
        data, starts = text_bytes(batch.column("text"))
        runs = batch.column("runs").flatten().flatten()
        low, size = (np.asarray(runs[i]).astype(np.int64) for i in (0, 1))
        count = np.diff(np.asarray(batch.column("runs").offsets))
        row = np.repeat(np.arange(batch.num_rows), count)
        begin = starts[row] + low
        cuts = [data[i:i + n].tobytes() for i, n in zip(begin, size)]
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(row), batch.column("mark").take(row), *runs[:1], *runs[2:],
             pa.array(cuts, pa.binary())],
            ["doc_id", "mark", "low", "again", "digit", "hot", "bytes"])


def _string_places(cuts: pa.Array, length: int, width: int):
    """Digits at every place of runs' bytes, and the strings: run index, place in its bytes, place of its digits."""
    data, starts = text_bytes(cuts)
    keys = digits(data[starts[0]:starts[-1]], width)
    begin = starts[:-1] - starts[0]
    count = np.diff(starts) - length + 1
    run = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return keys, run, inside, begin[run] + inside


def _cell_rows(batch: pa.RecordBatch, cut: pa.Array, length: int, size: int, row: np.ndarray, at: np.ndarray,
               cell: np.ndarray, strings: np.ndarray, keys: np.ndarray, begin: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Rows of CELLS: cells of `size` strings from `at` on (before 0: cut off) of rows with so many strings.

    `core` stands for the bytes that all strings of a cell hold, `whole` for all bytes of a full one.
    """
    width = digit_width(length)
    first, last = np.maximum(at, 0), np.minimum(at + size, strings[row])
    core = spans_hash(keys, width, begin[row] + at + size - 1, np.full(len(row), length - size + 1), MIX_A)
    full = last - first == size
    whole = np.zeros(len(row), np.uint64)
    whole[full] = spans_hash(keys, width, begin[row][full] + first[full], np.full(int(full.sum()), length + size - 1))
    cuts = [data[i:j].tobytes() for i, j in zip(begin[row] + first, begin[row] + last - 1 + length)]
    low = batch.column("low").to_numpy()[row] + first
    row = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(row), batch.column("mark").take(row), cut.take(row), pa.array(low.astype(np.int32)),
         pa.array((first - at).astype(np.int32)), pa.array((last - first).astype(np.int32)), batch.column("again").take(row),
         batch.column("digit").take(row), pa.array(cell.astype(np.int32)), pa.array(core.view(np.int64)),
         pa.array(whole.view(np.int64), mask=~full), pa.array(cuts, pa.binary())],
        [c.split()[0] for c in CELLS.split(", ")])


def _parts(batches: Iterator[pa.RecordBatch], width: int):
    """Some rows at a time, with their bytes, the digits at every place, and where each row begins."""
    for whole in batches:
        for first in range(0, whole.num_rows, 2000):
            batch = whole.slice(first, 2000)
            data, starts = text_bytes(batch.column("bytes"))
            data, starts = data[starts[0]:starts[-1]], starts - starts[0]
            yield batch, data, digits(data, width), starts


def _cells(length: int):
    """Cells of runs."""
    width = digit_width(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, keys, starts in _parts(batches, width):
            begin, strings = starts[:-1], np.diff(starts) - length + 1
            place = least_places(keys, length - width + 1)[begin] - begin
            least = -place // CELL
            count = (strings - 1 - place) // CELL - least + 1
            row = np.repeat(np.arange(len(begin)), count)
            cell = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            yield _cell_rows(batch, batch.column("low"), length, CELL, row, cell * CELL + place[row], cell, strings,
                             keys, begin, data)

    return run


def _halves(length: int, size: int):
    """Cells of `size` strings from cells of twice as many."""
    width = digit_width(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, keys, starts in _parts(batches, width):
            strings, skip, cell = (batch.column(n).to_numpy().astype(np.int64) for n in ("count", "skip", "cell"))
            row = np.repeat(np.arange(len(cell)), 2)
            half = np.tile([0, 1], len(cell))
            at = half * size - skip[row]
            good = np.maximum(at, 0) < np.minimum(at + size, strings[row])
            row, half, at = row[good], half[good], at[good]
            yield _cell_rows(batch, batch.column("run"), length, size, row, at, 2 * cell[row] + half, strings,
                             keys, starts[:-1], data)

    return run


def _hot_edges(runs: DataFrame, length: int) -> DataFrame:
    """EDGES of the runs of first digits that have many, without gathering a digit's runs.

    In each pass cells whose core occurs once leave, full cells that occur again are repeated with
    all their strings, and the others are halved, down to single strings. One cell of each
    repeated group goes on too, as its strings may be those of an open cell.
    """
    weight = F.sum(F.when(F.col("again"), 2).otherwise(1))
    size, found = CELL, []
    cells = stored(runs.mapInArrow(_cells(length), CELLS), "suffix-cells")
    while True:
        core, key = ["digit", "cell", "core"], ["digit", "cell", "whole"]
        # What is joined is stored before, so that hot keys of the join can be split.
        cores = stored(cells.groupBy(*core).agg(weight.alias("n")).where("n > 1").drop("n"), "suffix-cores")
        cells = stored(cells.join(cores, core), "suffix-open")
        full = cells.where("whole is not null")
        one = F.struct("doc_id", "mark", "run", "low", "skip", "count", F.lit(True).alias("again"), "digit", "cell", "bytes")
        wholes = stored(full.groupBy(*key).agg(weight.alias("n"), F.first(one).alias("one")).where("n > 1"), "suffix-wholes")
        found.append(full.where("not again").join(wholes.select(*key), key).select(
            "doc_id", "mark", "run", F.col("low").alias("begin"), (F.col("low") + F.col("count") - 1 + length).alias("end")))
        if size == 1:
            break
        size //= 2
        names = ["doc_id", "mark", "run", "low", "skip", "count", "again", "digit", "cell", "bytes"]
        rest = (cells.where("whole is null").select(*names)
                .union(full.join(wholes.select(*key), key, "left_anti").select(*names))
                .union(wholes.select("one.*")))
        cells = stored(rest.mapInArrow(_halves(length, size), CELLS), "suffix-cells")
    # All strings of a run hold its first digit, so what is repeated of it is one stretch.
    return reduce(DataFrame.union, found).groupBy("doc_id", "mark", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def sorted_edges(rows: pa.RecordBatch, length: int, width: int) -> pa.RecordBatch:
    """What the repeated strings of runs cover, from passes over the digits of all their strings.

    Runs of one first digit follow each other in `rows`. After each pass, strings whose
    group has one member leave; a string of a run that occurs again stands for two.
    """
    keys, run, inside, at = _string_places(rows.column("bytes"), length, width)
    first = rows.column("digit").to_numpy()
    group = np.concatenate(([0], np.cumsum(first[1:] != first[:-1])))[run]
    again = rows.column("again").to_numpy(zero_copy_only=False)
    held = np.arange(len(run))
    for place in [*range(0, length - width, width), length - width]:
        digit = keys[at[held] + place]
        order = np.lexsort((digit, group))
        held, group, digit = held[order], group[order], digit[order]
        new = np.ones(len(held), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        members = np.bincount(group, 1 + again[run[held]], minlength=1)
        held, group = (x[members[group] > 1] for x in (held, group))
    held = np.sort(held[~again[run[held]]])
    row, begins = np.unique(run[held], return_index=True)
    ends = np.append(begins, len(held))[1:] - 1
    low = rows.column("low").to_numpy()[row]
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id").take(take), rows.column("mark").take(take),
         pa.array((low + inside[held[begins]]).astype(np.int32)),
         pa.array((low + inside[held[ends]] + length).astype(np.int32))],
        ["doc_id", "mark", "begin", "end"])


def _edges(length: int):
    width = digit_width(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED_ROWS:
                rows = pa.concat_batches(held)
                digit = rows.column("digit").to_numpy()
                # The last first digit may go on in the next batch; it has few rows.
                done = int(np.searchsorted(digit, digit[-1], "left"))
                held = [rows.slice(done)]
                for first, last in _whole_groups(digit[:done]):
                    yield sorted_edges(rows.slice(first, last - first), length, width)
        if held:
            rows = pa.concat_batches(held)
            for first, last in _whole_groups(rows.column("digit").to_numpy()):
                yield sorted_edges(rows.slice(first, last - first), length, width)

    return run


def _whole_groups(digit: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SORTED_ROWS rows that do not part equal values of a sorted array."""
    first = 0
    while first < len(digit):
        last = min(first + SORTED_ROWS, len(digit))
        last = int(np.searchsorted(digit, digit[last - 1], "right"))
        yield first, last
        first = last


def _beside(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Rows of `docs` (doc_id, mark, others) with what `side` has for theirs; null ids are equal."""
    side = side.withColumnsRenamed({"doc_id": "__doc", "mark": "__its_mark"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__its_mark"))
    return docs.join(side, same, how).drop("__doc", "__its_mark")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, mark, begin, end): byte ranges, overlapping ones too, that repeated strings cover."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_mark().alias("mark"), "text")
    runs = stored(texts.mapInArrow(_runs(length), RUNS), "suffix-runs")

    # First digit.
    shared = runs.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("least"),
                                       F.max("stretch").alias("most"))
    # Stored before the join, so that a hot digit can be split there.
    shared = stored(shared.where("n > 1").select("digit", (F.col("least") != F.col("most")).alias("open")), "suffix-digits")
    runs = stored(runs.join(shared, "digit"), "suffix-shared")

    # Second digit.
    whole = runs.where("not open").select("doc_id", "mark", "low", "size")
    one = F.struct("doc_id", "mark", "low", "size")
    stretches = stored(runs.where("open").groupBy("digit", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(one).alias("at")), "suffix-stretches")
    again = runs.where("open").join(stretches.where("n > 1").select("digit", "stretch"), ["digit", "stretch"]) \
        .select("doc_id", "mark", "low", "size")

    # Last digits, of one run for each stretch, where any is alone with its own.
    groups = (stretches.groupBy("digit").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least"))
              .where("least = 1").select("digit", (F.col("runs") > HOT_RUNS).alias("hot")))
    wanted = (stretches.join(groups, "digit")
              .select("at.doc_id", "at.mark", F.struct("at.low", "at.size", (F.col("n") > 1).alias("again"),
                                                       "digit", "hot").alias("run"))
              .groupBy("doc_id", "mark").agg(F.collect_list("run").alias("runs")))
    cuts = stored(_beside(texts, wanted, "inner").select("doc_id", "mark", "text", "runs")
                  .mapInArrow(_cut_runs, CUTS), "suffix-cuts")
    few = (cuts.where("not hot").repartition("digit").sortWithinPartitions("digit")
           .mapInArrow(_edges(length), EDGES))
    edges = few.union(_hot_edges(cuts.where("hot"), length))
    spans = whole.union(again).select("doc_id", "mark", F.col("low").alias("begin"),
                                      (F.col("low") + F.col("size")).alias("end"))
    return stored(spans.union(edges), "suffix-spans")


def span_lists(spans: DataFrame) -> DataFrame:
    """The spans of each text. Equal rows have equal spans, of which one is kept before any shuffle."""
    return spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("__spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges of overlapping or touching spans, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to characters that lie in them wholly."""
    out = []
    for begin, end in spans:
        while begin < end and text[begin] & 0xC0 == 0x80:
            begin += 1
        while end < len(text) and end > begin and text[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[e for _, e in spans]]
    return b"".join(text[a:b] for a, b in zip(ends, [*[s for s, _ in spans], len(text)]))


ADDED = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def _finished(cut_text: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            asked = batch.column("__spans").to_pylist()
            texts, rows = [], []
            for i, spans in enumerate(asked):
                text = data[starts[i]:starts[i + 1]].tobytes()
                spans = merged(spans)
                kept = without(text, spans)
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
                if cut_text:
                    texts.append(without(text, whole_characters(text, spans)).decode())
            columns = [batch.column(n) for n in names]
            if cut_text:
                empty = batch.column("text").is_null().to_numpy(zero_copy_only=False)
                columns[names.index("text")] = pa.array(texts, pa.string(), mask=empty)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)]],
                [*names, *ADDED])

    return run


def mark_repeats(docs: DataFrame, length: int = LENGTH, cut_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept_sha256 to rows with `doc_id` and `text`.

    A byte is removed if a string of `length` bytes that covers it also starts somewhere
    else, in another row or the same. Null and empty texts count as empty. Every row is a
    document of its own, so repeated rows repeat each other, whatever their doc_id (null
    too); an empty table gives an empty result. Texts of any length are read in pieces of
    PIECE bytes. Columns of the input with the added names are replaced; names that start with
    two underscores are reserved. With `cut_text` the
    text loses the removed bytes, except for characters that only partly lie in them.
    """
    spans = repeated_spans(docs, length)
    per_text = span_lists(spans)
    docs = docs.drop(*ADDED)
    names = docs.columns
    held = docs.withColumns({"__doc_key": F.col("doc_id").cast("bigint"), "__text_mark": text_mark()})
    per_text = per_text.withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"})
    same = F.col("__doc_key").eqNullSafe(F.col("__doc")) & (F.col("__text_mark") == F.col("__mark"))
    joined = held.join(per_text, same, "left").select(*[f"`{n}`" for n in names], "__spans")
    schema = StructType(list(docs.schema.fields))
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)
    return joined.mapInArrow(_finished(cut_text, names), schema)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated strings cut out of `text`, in their own columns."""
    return mark_repeats(docs, length, cut_text=True).select(*[f"`{n}`" for n in docs.columns])
