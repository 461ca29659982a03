"""Phrase mining against plain counting, with tries so small that they burst, spill and start anew."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from starcell.llm import phrases
from tests.llm.samples import frame, same, texts

SCHEMA = "doc_id bigint, text string, lang string, rank int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
        yield [w for w in re.split(r"[ \t]+", piece) if w]


def mined(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang, _ in rows:
        own = counts.setdefault(lang or "und", Counter())
        for words in pieces(text):
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                own.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in frequent.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i:i + n]] = max(a, covered.get(p[i:i + n], 0))
        held = []
        for p, a in frequent.items():
            score, _, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, k) for k in range(1, len(p)))
            if 100 * covered.get(p, 0) < 80 * a:
                held.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(held)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def some_rows(seed=1):
    r = random.Random(seed)
    vocabulary = ["The", "of", "a", "né", "漢字", "x y", "don't", "#", "\x01b", *[f"w{i}" for i in range(15)]]
    fixed = ["new york city hall", "of the people", "a b a b a b", "WORD word Word"]
    rows = []
    for i in range(150):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.choice([1, 3, 30, 60]))]
        text = "".join(p + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", ";"]) for p in parts)
        rows.append((i, text, r.choice(["en", "en", "de", None]), i))
    rows += [(i, t, "fr", None) for i, t in texts(2)] + [(300, None, "en", 1), (301, "", None, 1), (302, " . ", "xx", 1)]
    return rows + rows[:20] + [(400, rows[0][1], "und", 1)]


@pytest.mark.parametrize("limits", [{}, {"full": 60, "burst": 16, "most_ids": 40, "bitmap_bits": 1 << 16}])
def test_mined_phrases(spark, limits):
    rows = some_rows()
    got = phrases.mine(frame(spark, rows, SCHEMA), 5, top=40, **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for n, t in got.dtypes if n not in ("lang", "phrase")} == {"bigint"}
    same(got.collect(), mined(rows, 5, 40))


def test_long_text_in_ranges(spark, monkeypatch):
    r = random.Random(3)
    long = "".join(r.choice(["aa", "b", "ccc", "the end"]) + r.choice([" ", " ", " ", ". ", "\n", "  "]) for _ in range(3000))
    for limit in (1, 7, 64):
        data = np.frombuffer(("x y. " + long + "z" * 50).encode(), np.uint8)
        starts = np.array([0, 5, len(data)])
        counter = phrases.Counter(range(2, 5), None, None, 1 << 20, 64, 1 << 20)
        for bounds, rows, new in phrases.text_blocks(data, starts, limit):
            counter.add(["en"] * len(rows), data, bounds, new)
        got = Counter()
        for batch in counter.runs(rest=True):
            got.update(dict(zip(batch.column("phrase").to_pylist(), batch.column("n").to_pylist())))
        want = Counter()
        for text in ("x y. ", data[5:].tobytes().decode()):
            for words in pieces(text):
                want.update(" ".join(words[i:i + n]) for n in (2, 3, 4) for i in range(len(words) - n + 1))
        assert got == want


def test_container_counts():
    r = np.random.default_rng(2)
    box = phrases.Container(16)
    want = Counter()
    for _ in range(5):
        high, low = r.integers(0, 40, 3000).astype(np.uint64), r.integers(0, 40, 3000).astype(np.uint64)
        box.add(high, low, np.ones(3000, np.int64))
        want.update(zip(high.tolist(), low.tolist()))
    assert {(h, l): n for h, l, n in zip(*(x.tolist() for x in box.entries()))} == want
    assert box.size == len(want) and 2 * box.size <= len(box.counts)


def test_trie_stays_in_order_and_spills_whole_containers():
    r = np.random.default_rng(5)
    trie = phrases.HatTrie(burst=20)
    high = r.zipf(1.3, 5000).clip(max=500).astype(np.uint64) << np.uint64(32) | r.integers(1, 50, 5000).astype(np.uint64)
    trie.add(high, np.zeros(5000, np.uint64))
    assert (np.diff(trie.bounds.astype(float)) > 0).all() and all(c.size <= 20 for c in trie.held)
    before = len(trie)
    taken = [x for x in trie.spill(before // 2)]
    assert len(trie) <= before // 2 and sum(len(h) for h, _, _ in taken) + len(trie) == before
    held = Counter()
    for h, _, n in [*taken, *trie.spill(0)]:
        held.update(dict(zip(h.tolist(), n.tolist())))
    assert held == Counter(high.tolist())


def test_empty_table(spark):
    assert phrases.mine(frame(spark, [], SCHEMA)).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    score = "(cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    a, l, r = 2**61 + 1, 2**62 + 5, 2**62 - 3
    row = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint").selectExpr(f"{score} as s").first()
    assert row.s == 2_000_000 * a // (l + r)
