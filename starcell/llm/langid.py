"""Language of a text by unigram pieces, all segmentations of it summed.

A language is a probability for each piece of a fixed public vocabulary. A text is its words,
each with a space before it, and the probability of a word is the sum over all ways to write
it as pieces, which a forward pass over its bytes gives. As no piece crosses a word, a text's
logarithm is the sum over its words, so every distinct word goes through the pass once per
task, for all languages at once. All 256 single bytes are pieces too: any text can be written.

The probabilities are learned by expectation and maximisation over word counts, from about
`most` labelled rows of each language. Words are counted, and expected piece counts summed,
in Spark; the driver sees one number per piece and language and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcell.llm.shared import mixed, powers, run_hashes, stored, text_bytes, word_blocks, words_of

UNKNOWN = "und"
MOST_LABELLED = 2000
ROUNDS = 4
# Added to every piece's expected count, and the least probability a piece may have.
SMOOTHING = 0.1
LEAST = 2.0 ** -32
# Words up to this length go through the pass together; each byte is scaled by 2 ** 12, so that
# sums of products stay within doubles (48 * 21 < 1022). Longer ones are rescaled byte by byte.
SHORT = 48
_SCALE = 12
# Words whose scores a task keeps.
KEPT_WORDS = 1 << 19
# Expected counts are summed in whole units of this, so that their order does not matter.
UNIT = 2.0 ** -10
# What the tables of a model may hold in bytes, as they are broadcast.
MODEL_BYTES = 1 << 28
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.uint8(0x20)
_BITS = 20


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a SentencePiece model as UTF-8, words starting with a space, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    found = {piece.replace("▁", " ").encode() for piece in plain}
    # A piece with a space inside crosses words.
    return sorted({piece for piece in found if b" " not in piece[1:]} | {bytes([b]) for b in range(256)})


class Pieces:
    """Numbers (from 1) of the pieces among all substrings of words, by an open hash table."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        self.power = powers(self.longest + 1, _BASE)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.numbers = np.zeros(1 << _BITS, np.int32)
        for number, key in enumerate(mixed(keys).tolist(), 1):
            slot = key >> (64 - _BITS)
            while self.numbers[slot]:
                slot = (slot + 1) & ((1 << _BITS) - 1)
            self.keys[slot], self.numbers[slot] = key, number

    @staticmethod
    def _key(piece: bytes) -> int:
        key = 0
        for byte in piece:
            key = (key * int(_BASE) + byte + 1) & (2**64 - 1)
        return key

    def prefixes(self, words: np.ndarray) -> np.ndarray:
        """Running hashes of the rows of a byte matrix, one column more than it has."""
        out = np.zeros((words.shape[1] + 1, words.shape[0]), np.uint64)
        for i in range(words.shape[1]):
            out[i + 1] = out[i] * _BASE + words[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def numbers_of(self, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
        """Piece numbers, 0 for none, of the substrings between running hashes."""
        keys = mixed(high - low * self.power[length])
        slots = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
        out = self.numbers[slots]
        other = np.flatnonzero((out > 0) & (self.keys[slots] != keys))
        while len(other):
            slots[other] = (slots[other] + 1) & ((1 << _BITS) - 1)
            out[other] = self.numbers[slots[other]]
            other = other[(out[other] > 0) & (self.keys[slots[other]] != keys[other])]
        return out


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def _steps(pieces: Pieces, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, length, rows, piece numbers) of all pieces in words of one length, by their end."""
    before = pieces.prefixes(words)
    for end in range(1, words.shape[1] + 1):
        for length in range(1, min(end, pieces.longest) + 1):
            numbers = pieces.numbers_of(before[end - length], before[end], length)
            rows = np.flatnonzero(numbers)
            if len(rows):
                yield end, length, rows, numbers[rows]


def forward(pieces: Pieces, words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log probabilities of words (a byte matrix) in each language of `table` (pieces + 1, languages)."""
    n = words.shape[1]
    sums = np.zeros((n + 1, len(words), table.shape[1]))
    sums[0] = 1
    for end, length, rows, numbers in _steps(pieces, words):
        sums[end, rows] += np.ldexp(sums[end - length, rows] * table[numbers], _SCALE * length)
    return np.log(sums[n]) - n * _SCALE * np.log(2)


def forward_long(pieces: Pieces, word: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The same of one word of any length: only the last few sums are held, rescaled at each byte."""
    held = np.zeros((pieces.longest, table.shape[1]))      # the latest first
    held[0] = 1
    total = np.zeros(table.shape[1])
    window, at = 1 << 14, 0
    before = np.zeros(pieces.longest + 1, np.uint64)       # running hashes, of the latest bytes
    while at < len(word):
        part = word[at:at + window]
        running = pieces.prefixes(part[None, :])[:, 0]
        running += before[-1] * powers(len(part) + 1, _BASE)
        running = np.concatenate((before[:-1], running))
        first = pieces.longest
        numbers = np.stack([pieces.numbers_of(running[first + 1 - k:first + 1 - k + len(part)],
                                              running[first + 1:], k) for k in range(1, first + 1)])
        for i in range(len(part)):
            reach = min(pieces.longest, at + i + 1)
            now = (held[:reach] * table[numbers[:reach, i]]).sum(0)
            total += np.log(now)
            held[1:] = held[:-1] / now
            held[0] = 1
        before = running[-(pieces.longest + 1):]
        at += window
    return total


def expected(pieces: Pieces, words: np.ndarray, table: np.ndarray, language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses, in UNITs, of each piece per language: (pieces + 1, languages).

    A piece's share of a word is the sum over the segmentations that use it there, over the
    sum over all; the sums behind each place come from a backward pass.
    """
    n = words.shape[1]
    sums = np.zeros((n + 1, len(words)))
    sums[0] = 1
    steps = list(_steps(pieces, words))
    weights = [np.ldexp(table[numbers, language[rows]], _SCALE * length) for _, length, rows, numbers in steps]
    for (end, length, rows, _), weight in zip(steps, weights):
        sums[end, rows] += sums[end - length, rows] * weight
    behind = np.zeros((n + 1, len(words)))
    behind[n] = times / sums[n]
    cells, shares = [], []
    for (end, length, rows, numbers), weight in zip(reversed(steps), reversed(weights)):
        back = weight * behind[end, rows]
        behind[end - length, rows] += back
        cells.append(numbers * table.shape[1] + language[rows])
        shares.append(np.rint(sums[end - length, rows] * back / UNIT))
    return np.bincount(np.concatenate(cells), np.concatenate(shares), table.size).reshape(table.shape)


def _matrices(cells: list[bytes] | pa.Array, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, byte matrix with a space in front) of words up to `longest` bytes, by their length."""
    data, starts = text_bytes(cells if isinstance(cells, pa.Array) else pa.array(cells, pa.large_binary()))
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes < longest]).tolist():
        rows = np.flatnonzero(sizes == size)
        words = np.full((len(rows), size + 1), _SPACE, np.uint8)
        words[:, 1:] = data[starts[rows][:, None] + np.arange(size)]
        yield rows, words


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray       # probability of each piece (from row 1 on) in each language
    prior: np.ndarray       # log share of each language
    path: str               # of the vocabulary


class Words:
    """Log probabilities of words, of which a task keeps those it has met."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, pieces_of(model.path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(self.model.languages)))

    def of(self, cells: pa.Array) -> np.ndarray:
        out = np.zeros((len(cells), len(self.model.languages)))
        for rows, words in _matrices(cells, SHORT):
            out[rows] = forward(self.pieces, words, self.model.table)
        data, starts = text_bytes(cells)
        for row in np.flatnonzero(np.diff(starts) >= SHORT).tolist():
            word = np.concatenate(([_SPACE], data[starts[row]:starts[row + 1]]))
            out[row] = forward_long(self.pieces, word, self.model.table)
        return out

    def text_logs(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums over the words of consecutive ranges of `data`, one row per range."""
        low = int(bounds[0])
        part, bounds = data[low:int(bounds[-1])], bounds - low
        first, last, owner = words_of(part, bounds)
        out = np.zeros((len(bounds) - 1, len(self.model.languages)))
        if not len(first):
            return out
        keys, at, inverse = np.unique(run_hashes(part, first, last), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != keys[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > KEPT_WORDS:
                self._forget()
                new[:], place[:] = True, 0
            cells = pa.array([part[i:j].tobytes() for i, j in zip(first[at[new]], last[at[new]])], pa.large_binary())
            self.logs = np.insert(self.logs, place[new], self.of(cells), axis=0)
            self.known = np.insert(self.known, place[new], keys[new])
            place = np.searchsorted(self.known, keys)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner, self.logs[place[inverse], k], len(out))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word, times) of labelled texts, counted per language and block."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        data, starts = text_bytes(batch.column("text"))
        for row in range(batch.num_rows):
            for bounds, _ in word_blocks(data, starts[row:row + 2]):
                low = int(bounds[0])
                part = data[low:int(bounds[-1])]
                first, last, _ = words_of(part, bounds - low)
                short = last - first < SHORT
                counted = pa.array([part[i:j].tobytes() for i, j in zip(first[short], last[short])], pa.binary()).value_counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[row]] * len(counted), pa.string()), counted.field(0), counted.field(1)],
                    ["lang", "word", "times"])


def fit(docs: DataFrame, path: str, most: int = MOST_LABELLED, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from rows with `text` and `lang`; rows where either is null teach nothing.

    Of a language with more than `most` rows, each row is used with that probability, by a hash
    of its text, so repeated rows are used together. Languages are the labels that occur; without
    any, the model knows none. Words of `SHORT` bytes or more are left out of learning. Raises
    where the table of probabilities would take more than MODEL_BYTES.
    """
    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    sizes = sorted((r.lang, r.n) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
                   .limit(MODEL_BYTES // 8 // 256 + 1).collect())
    languages = [name for name, _ in sizes]
    pieces = pieces_of(path)
    shape = (len(vocabulary(path)) + 1, len(languages))
    if shape[0] * shape[1] * 8 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages need a table of more than {MODEL_BYTES} bytes")
    table = np.full(shape, 1 / (shape[0] - 1))
    table[0] = 0
    rows = np.array([n for _, n in sizes], float)
    model = Model(languages, table, np.log(rows / rows.sum()) if len(rows) else rows, path)
    if not languages:
        return model
    share = F.create_map(*[x for name, n in sizes for x in (F.lit(name), F.lit(min(1.0, most / n)))])[F.col("lang")]
    drawn = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    counts = stored(drawn.mapInArrow(_word_counts, "lang string, word binary, times bigint")
                    .groupBy("lang", "word").agg(F.sum("times").alias("times")), "langid-words")
    number = {name: i for i, name in enumerate(languages)}

    for _ in range(rounds):
        now = model.table

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own, total = pieces_of(path), np.zeros(now.shape)
            for batch in batches:
                language = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                times = batch.column("times").to_numpy().astype(np.float64)
                for at, words in _matrices(batch.column("word"), SHORT):
                    total += expected(own, words, now, language[at], times[at])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], ["at", "units"])

        found = (counts.mapInArrow(run, "at bigint, units bigint").groupBy("at")
                 .agg(F.sum("units").alias("units")).toPandas())
        uses = np.zeros(now.size)
        uses[found["at"].to_numpy()] = found["units"].to_numpy() * UNIT
        uses = uses.reshape(now.shape)[1:] + SMOOTHING
        model.table = np.vstack([np.zeros(len(languages)), np.maximum(uses / uses.sum(0), LEAST)])
    return model


ADDED = ("lang_pred", "score")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `lang_pred` and `score`, its share (0 to 1) of all languages' probabilities, to rows with a `text`.

    A text that is null or has no letter is `und` with a score of 0, as is every text where
    the model knows no language. Rows are judged one by one in the task that reads them: equal
    texts get equal results, an empty table gives an empty one, and nothing is shuffled. Long
    texts are read in ranges of whole words, so memory follows the longest word, not the text.
    Ties go to the language that comes first by name. Columns of the input with the added names
    are replaced; names that start with two underscores are reserved.
    """
    docs = docs.drop(*ADDED)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model) if model.languages else None
        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if words:
                logs = np.tile(model.prior, (batch.num_rows, 1))
                for bounds, rows in word_blocks(data, starts):
                    logs[rows] += words.text_logs(data, bounds)
                share = np.exp(logs - logs.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                chosen = share.argmax(1)
                score = np.where(letters, share.max(1), 0.0) if len(share) else score
                best = [model.languages[k] if has else UNKNOWN for k, has in zip(chosen, letters)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(best, pa.string()), pa.array(score)], [*names, *ADDED])

    held = docs.withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return held.mapInArrow(run, StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double"))
