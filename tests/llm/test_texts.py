"""Operators that judge, count, encode or score each text by itself."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starcell.llm import classifier, idfiles, packing, quality, queries, tokens, urlrules
from starcell.llm.encoding import Encoder
from starcell.session import fresh_path
from tests.llm.samples import WORD, frame, same, texts

BPE = queries.BPE_50K
PIECE = queries.PIECE_32K
ODD = ["a", " ", "\n", "é", "漢", "𠀀", "the ", "ing", "  ", "\t", "<|endoftext|>", "<s>", "▁", "\x1c", "\x85", "\xa0",
       "'s", "'", "1", "...", "!\x1c", "\r\n", "    ", "​", "x,", ", ", "Word.\n", "b;c", "\x0b"]


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(part) for _ in range(r.randint(0, 120)))
            for _ in range(n) for part in [r.sample(ODD, r.randint(1, 8))]]


# Quality rules

def covered(words, n):
    seen = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return {j for i in range(len(words) - n + 1) if seen[tuple(words[i:i + n])] > 1 for j in range(i, i + n)}


def test_quality_measures(spark):
    rows = texts(7)
    got = quality.judge(frame(spark, rows)).collect()
    want = []
    for name, text in rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        repeat = len(covered(words, 8))
        share = [sum(len(words[i]) for i in covered(words, n)) for n in sorted(quality.MAX_COVERED)]
        again = sum(len(w) for x in lines if lines.count(x) > 1 for w in WORD.findall(x))
        chars = sum(map(len, words))
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        symbols = sum((text or "").count(c) for c in quality.SYMBOLS)
        good = (not failed and 100 * symbols <= quality.MAX_SYMBOLS_PCT * len(words)
                and all(100 * s <= most * chars for s, (_, most) in zip(share, sorted(quality.MAX_COVERED.items())))
                and 100 * again <= quality.MAX_LINE_COVERED * chars)
        want.append((name, len(words), chars, symbols, len(lines) - len(set(lines)), repeat, *share, again, failed, good))
    same([(r.doc_id, *[r[m] for m in quality.MEASURES], r.base_failed, r.kept) for r in got], want)


def test_quality_on_empty_table_and_clashing_columns(spark):
    docs = frame(spark, [(1, "a b " * 30, 9), (2, " ".join(f"v{i}" for i in range(50)), None)],
                 "doc_id bigint, text string, n_words int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert quality.judge(frame(spark, [])).count() == 0


# URL rules

def test_url_rules_against_plain_rules(spark):
    r = random.Random(3)
    hosts = ["net", "a.net", "example.net", "x.example.NET", "example.com", "notexample.com", "b.org", "org", "anet", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/1", "/fr/", "/a.net/en/", "/é/fr/", "/en/" + "y" * 3000]
    urls = [None, "", "no scheme", "http://"] + [
        f"{r.choice(['http', 'HTTPS', ''])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/en/', '#x/de/'])}"
        for _ in range(300)]
    rows = list(enumerate(urls))
    want = []
    for i, url in rows:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [x for x in queries.URL_RULES for h, p in [x.pattern.split("/", 1)]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda x: len(x.pattern), default=None)
        want.append((i, host, path, best and best.pattern, best.action if best else "allow"))
    got = urlrules.judge(frame(spark, rows, "page_id bigint, url string"), queries.URL_RULES)
    same(got.select("page_id", "host", "path", "rule", "verdict").collect(), want)
    assert urlrules.judge(frame(spark, [], "page_id bigint, url string"), queries.URL_RULES).count() == 0


def test_url_globs_over_many_words(spark):
    rules = [urlrules.Rule("block", f"h{i}*.example/p*{i}/") for i in range(40)]
    rows = [(1, "http://h7abc.example/pqq7/z", "old"), (2, "http://h7/x.example/pqq7/z", None), (3, "http://sub.h39.example/p39/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(
        frame(spark, rows, "page_id bigint, url string, rule string"), rules, "allow").collect()}
    assert got == {1: ("h7*.example/p*7/", "block"), 2: (None, "allow"), 3: ("h39*.example/p*39/", "block")}


# Token counts, ids, files, packing

@pytest.mark.parametrize("chunk,overlap", [(60, 8), (25, 1)])
def test_spliced_counts(chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counter = tokens.Counter(PIECE, chunk, overlap)
    for text in odd_texts(1, 400):
        assert counter.count(text) == len(model.encode(text)), text


def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = texts(2)
    got = tokens.token_counts(frame(spark, rows), PIECE, 100, chunk=300, overlap=20)
    want = [(name, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for name, t in rows]
    same(got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect(), want)
    assert tokens.token_counts(frame(spark, []), PIECE, 100).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_librarys_ids(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), Encoder(path)
    held = odd_texts(4, 1500) + [t or "" for _, t in texts(4)]
    for text, ids in zip(held, own.encode(held)):
        assert library.encode(text, add_special_tokens=False).ids == ids.tolist(), text


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    packed = idfiles.pack_bits(ids, bits)
    assert len(packed) == (1001 * bits + 7) // 8
    for first, count in ((0, 1001), (3, 0), (17, 500), (1000, 1)):
        assert (idfiles.unpack_bits(packed, bits, first, count) == ids[first:first + count]).all()


def test_id_files(spark):
    library = Tokenizer.from_file(BPE)
    rows = texts(5)
    path = fresh_path(spark, "ids")
    idfiles.write(frame(spark, rows), path, BPE, 0, block_ids=300)
    got = sorted(idfiles.documents(spark, path).collect(), key=lambda r: r.start)
    coded = Counter((name, tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for name, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == coded
    assert [r.doc_id for r in got] == sorted([n for n, _ in rows], key=lambda n: -1 if n is None else n)
    stream, at = [], 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        stream += r.ids
        at += len(r.ids)
    parts = sorted(idfiles.stream_slice(spark, path, 137, 2000).collect())
    assert [x for _, ids in parts for x in ids] == stream[137:2137]
    empty = fresh_path(spark, "ids")
    idfiles.write(frame(spark, []), empty, BPE)
    assert idfiles.documents(spark, empty).count() == 0


def test_packing(spark):
    library = Tokenizer.from_file(BPE)
    rows = texts(6)
    got = packing.pack(frame(spark, rows).coalesce(1), BPE, 256, 0, open_bins=8).collect()
    want = []
    for name, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (start, n) in enumerate(packing.pieces(len(ids), 256)):
            want.append((name, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
    same([r[:5] for r in got], want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = 0
        for offset, n in sorted(places):
            assert offset == ends
            ends += n
        assert ends <= 256
    assert len(held) <= 1.1 * sum(r.length for r in got) / 256 + 8
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_tails_of_tasks_are_joined(spark):
    """As many sequences from one task as from sixteen, hardly more than the ids need; extra columns clash."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(("data", "of", "the", "model")) for _ in range(r.randint(1, 150)))) for i in range(300)]
    docs = frame(spark, rows).withColumns({"sequence_id": F.lit("x"), "offset": F.lit(None), "piece": F.lit(-1)})
    made = []
    for parts in (1, 16):
        got = packing.pack(docs.repartition(parts, "doc_id"), BPE, 256).collect()
        assert sorted((p.doc_id, p.piece) for p in got) == [(i, 0) for i in range(300)]
        held = {}
        for p in got:
            held.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for places in held.values():
            assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1]]
        need = -(-sum(p.length for p in got) // 256)
        assert len(held) <= 1.03 * need + 1
        made.append(len(held))
    assert abs(made[0] - made[1]) <= 1


def best_fit(sizes, capacity, most):
    """Bounded-space best-fit by looking at all open bins."""
    spaces, made, places = {}, 0, []
    for n in sizes:
        fits = [(free, b) for b, free in spaces.items() if free >= n]
        if fits:
            b = min(fits)[1]
        else:
            if len(spaces) == most:
                del spaces[min(spaces, key=spaces.get)]
            b, made = made, made + 1
            spaces[b] = capacity
        places.append(spaces[b])
        spaces[b] -= n
        if not spaces[b]:
            del spaces[b]
    return places, made, sorted(spaces.values())


def test_bins_against_all_open_bins():
    """The same free space is taken at every step; which of two equally full bins it is does not matter."""
    r = random.Random(2)
    for most in (1, 3, 20):
        sizes = [r.randint(1, 100) for _ in range(2000)]
        bins, taken = packing.Bins(100, most), []
        for n in sizes:
            taken.append(100 - bins.place(n)[1])
        left = sorted(free for free, numbers in bins.by_free.items() for _ in numbers)
        assert (taken, bins.made, left) == best_fit(sizes, 100, most)
        assert len(bins.left_open()) == len(left) == bins.open


def test_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    assert bins.place(5) == (2, 5) and bins.open == 0
    assert [bins.place(n)[0] for n in (9, 8, 7, 2)] == [3, 4, 5, 4]   # bin 3, the fullest, has closed


# Classifier

def test_classifier(spark):
    r = random.Random(9)
    good, bad = (["%s%d" % (c, i) for i in range(80)] for c in "gb")
    rows = [(i, " ".join(r.choice(bad if i % 3 == 0 else good) for _ in range(40))) for i in range(240)]
    rows += [(1000, None), (1001, ""), (None, "x"), rows[0], (1002, "q" * 5000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(180)] + [(None, 1), (5, None), (9999, 1)],
                                   "doc_id bigint, label int")
    model = classifier.fit(docs, labels, most=150)
    got = classifier.score(docs.withColumn("score", F.lit("old")), classifier.Model.from_bytes(model.to_bytes())).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    late = [x for x in got if x.doc_id is not None and 180 <= x.doc_id < 240]
    assert all((x.score >= 0.5) == (x.doc_id % 3 != 0) for x in late)
    none = classifier.fit(docs, labels.limit(0))
    assert {x.score for x in classifier.score(docs, none).collect()} == {0.5}
    assert classifier.score(frame(spark, []), model).count() == 0
