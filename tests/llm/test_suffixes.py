import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starcell.llm import suffixes
from tests.llm.samples import frame, same, texts

ADDED = list(suffixes.ADDED)


def brute(rows, length):
    held = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in held for i in range(len(b) - length + 1))
    out = []
    for (name, _), b in zip(rows, held):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((name, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot", [(24, 256), (40, 2), (200, 256)])
def test_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    rows = texts(length)
    got = suffixes.mark_repeats(frame(spark, rows), length).select("doc_id", *ADDED).collect()
    same(got, brute(rows, length))


def test_equal_rows_share_their_spans(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    held = []
    for n in (300, 2000):
        docs = frame(spark, [(7, text)] * n + [(8, text[:900] + "!" + text[900:])])
        lists = suffixes.span_lists(suffixes.repeated_spans(docs, 200)).select(F.size("__spans").alias("n")).collect()
        held.append(sum(r.n for r in lists))
        got = suffixes.mark_repeats(docs, 200).groupBy("doc_id", "n_removed").count().collect()
        assert {(r.doc_id, r.n_removed, r["count"]) for r in got} == {(7, len(text), n), (8, len(text), 1)}
    assert held[0] == held[1]


@pytest.mark.parametrize("size", [1, 2, 8])
def test_halved_cells(spark, monkeypatch, size):
    monkeypatch.setattr(suffixes, "HOT_RUNS", 1)
    monkeypatch.setattr(suffixes, "CELL", size)
    core = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))[:150]
    rows = [(i, f"{i:05}" * 20 + "left"[i % 5:] + core + "right"[:i % 4] + f"{i:04}" * 20) for i in range(40)]
    rows += rows[:3] + [(None, core * 2)]
    for length in (100, 152):
        got = suffixes.mark_repeats(frame(spark, rows), length).select("doc_id", *ADDED).collect()
        same(got, brute(rows, length))


def test_long_text_in_pieces(spark):
    rows = [(1, "ab" * 700_000), (2, "".join(chr(97 + i * i % 23) + str(i) for i in range(250_000))), (3, "cd" * 90)]
    got = {r.doc_id: r for r in suffixes.mark_repeats(frame(spark, rows), 200).collect()}
    assert got[1].n_removed == 1_400_000 and got[1].n_spans == 1
    assert got[2].n_removed == 0 and got[3].n_removed == 0


def test_empty_table_and_clashing_columns(spark):
    assert suffixes.mark_repeats(frame(spark, []), 200).count() == 0
    rows = [(1, "y" * 250, 5, "q"), (2, "z", 6, None)]
    docs = frame(spark, rows, "doc_id bigint, text string, n_bytes int, `mark` string")
    got = {r.doc_id: r.asDict() for r in suffixes.mark_repeats(docs, 200).collect()}
    assert got[1]["n_bytes"] == 250 and got[1]["mark"] == "q" and got[1]["n_removed"] == 250
    kept = suffixes.cut_repeats(docs, 200)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"", "z"}


def test_cut_text_keeps_whole_characters(spark):
    shared = "é" * 110
    rows = [(1, "aè" + shared + "b"), (2, "cé" + shared + "ê"), (3, None)]
    got = {r.doc_id: r.text for r in suffixes.cut_repeats(frame(spark, rows), 200).collect()}
    assert got[3] is None and got[1] == "aèb" and got[2] == "cê"


def test_texts_of_one_short_hash_are_cut_apart(spark):
    shared = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    ids = spark.range(200_000)
    with_it = ids.selectExpr(f"concat('{shared}', id) AS a").withColumn("h", F.hash("a"))
    other = "".join(chr(97 + i * i * i % 23) + str(i) for i in range(100, 180))
    without = ids.selectExpr(f"concat(id, '{other}') AS b").withColumn("h", F.hash("b"))
    pair = with_it.join(without, "h").first()
    docs = frame(spark, [(None, pair.a), (None, pair.b), (1, shared + "z")])
    got = {r.text: r.n_removed for r in suffixes.mark_repeats(docs, 100).collect()}
    assert got == {pair.a: len(shared), pair.b: 0, shared + "z": len(shared)}
