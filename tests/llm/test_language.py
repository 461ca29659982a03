"""Language identification against plain sums over all segmentations, and on odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starcell.llm import langid, queries
from tests.llm.samples import frame, texts

SF_DIR = "/root/testdata/sf0.01"
PIECES = langid.pieces_of(queries.PIECE_32K)
VOCABULARY = langid.vocabulary(queries.PIECE_32K)
NUMBER = {piece: i for i, piece in enumerate(VOCABULARY, 1)}


def some_table(languages=3, seed=4):
    r = np.random.default_rng(seed)
    table = np.maximum(r.dirichlet(np.full(len(VOCABULARY), 0.1), languages).T, langid.LEAST)
    return np.vstack([np.zeros(languages), table])


def segmentations(word: bytes):
    """All ways to write a word as pieces."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in NUMBER:
            for rest in segmentations(word[n:]):
                yield (word[:n], *rest)


def plain_log(word: bytes, table) -> np.ndarray:
    """The forward sums, with logarithms and one piece at a time."""
    sums = [np.zeros(table.shape[1])]
    for end in range(1, len(word) + 1):
        ways = [sums[i] + np.log(table[NUMBER[word[i:end]]]) for i in range(max(0, end - 64), end) if word[i:end] in NUMBER]
        sums.append(np.logaddexp.reduce(ways))
    return sums[-1]


WORDS = ["the", "Verständnis", "x", "漢字", "été,", "a" * 47, "representation", "#$%", "\U00020000b"]


def test_forward_sums_all_segmentations():
    table = some_table()
    for word in ("the", "in,", "äb"):
        cell = b" " + word.encode()
        want = sum(math.prod(table[NUMBER[p], 1] for p in way) for way in segmentations(cell))
        matrix = np.frombuffer(cell, np.uint8)[None]
        assert langid.forward(PIECES, matrix, table)[0, 1] == pytest.approx(math.log(want), abs=1e-9)
    words = langid.Words(langid.Model(["a", "b", "c"], table, np.zeros(3), queries.PIECE_32K))
    got = words.of(pa.array([w.encode() for w in WORDS], pa.large_binary()))
    for word, row in zip(WORDS, got):
        np.testing.assert_allclose(row, plain_log(b" " + word.encode(), table), rtol=1e-9)


@pytest.mark.parametrize("word", ["a" * 48, "ab漢" * 5000, "-" * 200, "responsibility" * 40])
def test_long_words(word):
    table = some_table()
    matrix = np.frombuffer(b" " + word.encode(), np.uint8)
    np.testing.assert_allclose(langid.forward_long(PIECES, matrix, table), plain_log(matrix.tobytes(), table), rtol=1e-9)


def test_expected_uses():
    table = some_table()
    words, language, times = ["the", "then", "zzz", "été"], np.array([0, 2, 1, 0]), np.array([3.0, 1.0, 2.0, 7.0])
    want = np.zeros(table.shape)
    for word, k, n in zip(words, language, times):
        ways = list(segmentations(b" " + word.encode()))
        odds = np.array([math.prod(table[NUMBER[p], k] for p in way) for way in ways])
        for way, share in zip(ways, odds / odds.sum()):
            for piece in way:
                want[NUMBER[piece], k] += n * share
    got = np.zeros(table.shape)
    for rows, matrix in langid._matrices([w.encode() for w in words], langid.SHORT):
        got += langid.expected(PIECES, matrix, table, language[rows], times[rows]) * langid.UNIT
    np.testing.assert_allclose(got, want, atol=0.05)


def learned(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    return langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), queries.PIECE_32K, 200, 3)


def test_held_out_accuracy_and_odd_rows(spark):
    model = learned(spark)
    assert model.languages == ["de", "en", "es", "fr"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    got = langid.predict(docs, model).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("right"), "score").toPandas()
    assert got["right"].mean() >= 0.98 and got["score"].between(0, 1).all()

    rows = [(i, t, "clash") for i, t in [*texts(5), (900, "123 ... 456"), (901, "7\n"), (902, "ж" * 70_000)]]
    odd = frame(spark, rows, "doc_id bigint, text string, score string")
    found = langid.predict(odd, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    held = found.collect()
    assert len(held) == len(rows)
    by_text = {}
    for row in held:
        letters = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == langid.UNKNOWN) == (not letters) and 0 <= row.score <= 1
        assert letters or row.score == 0
        assert by_text.setdefault(row.text, (row.lang_pred, row.score)) == (row.lang_pred, row.score)
    empty = frame(spark, [], "doc_id bigint, text string")
    assert langid.predict(empty, model).count() == 0


def test_texts_in_ranges_score_like_whole_ones(spark, monkeypatch):
    model = learned(spark)
    words = langid.Words(model)
    text = np.frombuffer(" ".join(t for _, t in texts(3) if t).encode(), np.uint8)
    whole = words.text_logs(text, np.array([0, len(text)]))
    monkeypatch.setattr(langid, "KEPT_WORDS", 50)
    parts = sum(langid.Words(model).text_logs(text, bounds)
                for bounds, _ in langid.word_blocks(text, np.array([0, len(text)]), 700))
    np.testing.assert_allclose(parts, whole, rtol=1e-9)


def test_no_labels_know_no_language(spark):
    model = langid.fit(frame(spark, [(1, "a b", None), (2, None, "en")], "doc_id bigint, text string, lang string"), queries.PIECE_32K)
    assert model.languages == []
    got = langid.predict(frame(spark, [(1, "some words")]), model).first()
    assert (got.lang_pred, got.score) == (langid.UNKNOWN, 0.0)
