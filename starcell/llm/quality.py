"""Quality rules: how much of a text lies in what it repeats.

Rolling word hashes give every n-gram of a text a key; n-grams whose key occurs twice
or more in the same text are duplicated, and the characters of the words they cover are
measured against all word characters. The same is done with whole lines. Each text is
judged alone, in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from starcell.llm.shared import gram_hashes, mixed, repeated, row_blocks, run_hashes, text_bytes, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
# Largest share, in percent, of word characters inside duplicated n-grams and lines.
MAX_COVERED = {3: 60, 5: 50, 8: 40, 10: 40}
MAX_LINE_COVERED = 40
# Most symbols for a hundred words.
MAX_SYMBOLS_PCT = 30

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LENGTHS = tuple(sorted(MAX_COVERED))

MEASURES = (["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            + [f"covered_{n}" for n in _LENGTHS] + ["covered_lines"])


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)


def _covered(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its own text has twice or more."""
    out = np.zeros(len(hashes) + 1, np.int64)
    keys = gram_hashes(hashes, n)
    if len(keys):
        whole = np.flatnonzero(owner[:len(keys)] == owner[n - 1:])
        twice = whole[repeated(mixed(keys[whole] ^ (owner[whole].astype(np.uint64) << np.uint64(40))))]
        out[twice] += 1
        out[twice + n] -= 1
    return np.cumsum(out[:-1]) > 0


def _measure(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of consecutive texts; `starts` counts from 0."""
    n = len(starts) - 1
    first, last, owner = words_of(data, starts)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[last] - points[first]
    hashes = run_hashes(data, first, last)
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data])))
    out = {"n_words": _per_text(np.ones(len(owner)), owner, n), "word_chars": _per_text(chars, owner, n),
           "n_symbols": symbols[starts[1:]] - symbols[starts[:-1]]}
    for length in _LENGTHS:
        inside = _covered(hashes, owner, length)
        out[f"covered_{length}"] = _per_text(chars * inside, owner, n)
        if length == WINDOW:
            out["n_repeat_words"] = _per_text(inside.astype(float), owner, n)

    # Lines: between line feeds and text bounds, compared byte by byte through their hash.
    cuts = np.unique(np.concatenate((starts, np.flatnonzero(data == 10) + 1)))
    begin, end = cuts[:-1], cuts[1:].copy()
    if len(begin):
        end -= data[end - 1] == 10
        line_of = np.searchsorted(begin, first, "right") - 1
        with_word = np.zeros(len(begin), bool)
        with_word[line_of] = True
        kept = np.flatnonzero(with_word)
        text_of = np.searchsorted(starts, begin[kept], "right") - 1
        keys = mixed(run_hashes(data, begin[kept], end[kept])
                     ^ (text_of.astype(np.uint64) << np.uint64(40)))
        order = np.argsort(keys, kind="stable")
        later = np.zeros(len(kept), bool)
        later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(len(begin), bool)
        again[kept] = repeated(keys)
        out["n_dup_lines"] = _per_text(later.astype(float), text_of, n)
        out["covered_lines"] = _per_text(chars * again[line_of], owner, n)
    else:
        out["n_dup_lines"] = out["covered_lines"] = np.zeros(n, np.int64)
    return out


def _verdicts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, starts = text_bytes(batch.column("text"))
    parts = [_measure(data[starts[i]:starts[j]], starts[i:j + 1] - starts[i])
             for i, j in row_blocks(starts)]
    m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in MEASURES}
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])
    good = ~failed & (100 * m["n_symbols"] <= MAX_SYMBOLS_PCT * m["n_words"])
    for length, most in MAX_COVERED.items():
        good &= 100 * m[f"covered_{length}"] <= most * m["word_chars"]
    good &= 100 * m["covered_lines"] <= MAX_LINE_COVERED * m["word_chars"]
    return m | {"base_failed": failed, "kept": good}


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = _verdicts(batch)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(v) for v in m.values()]], [*batch.schema.names, *m])


def _good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_verdicts(batch)["kept"]))


def judge(docs: DataFrame) -> DataFrame:
    """Adds the measures, `base_failed` and `kept` to documents with a `text`.

    Null and empty texts have no words: all measures 0, failed, not kept. Rows are
    judged one by one, so repeated rows give repeated results, and an empty table an
    empty one. Columns of the input whose names clash with a measure are replaced.
    Memory follows the longest single text, about sixty times its bytes.
    """
    added = [*MEASURES, "base_failed", "kept"]
    docs = docs.drop(*added)
    schema = StructType(list(docs.schema.fields))
    for name in MEASURES:
        schema = schema.add(name, "long")
    return docs.mapInArrow(_judged, schema.add("base_failed", "boolean").add("kept", "boolean"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all the columns they came with."""
    return docs.mapInArrow(_good, docs.schema)
