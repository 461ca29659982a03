import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starcell.llm import jaccard
from tests.llm.samples import WORD, frame, same, texts

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return [(name, len(s), least.get(root(i)) if s else name) for i, ((name, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block,split", [(128, 12), (3, 2)])
def test_brute_force(spark, monkeypatch, block, split):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "LONG_FROM", split)
    rows = texts(block, 90)
    docs = frame(spark, rows)
    want = brute(rows)
    same(jaccard.classes(docs).select("doc_id", "n_shingles", "component_id").collect(), want)
    kept = jaccard.keep_one(docs).collect()
    full = {c for _, n, c in want if n}
    assert len(kept) == len(full) + sum(1 for _, n, _ in want if not n)
    assert full - {None} <= {r.doc_id for r in kept}


def test_skipped_long_lists_find_all():
    import numpy as np

    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = sorted((np.unique(np.where(r.random(len(base)) < p, r.integers(0, 1 << 60, len(base)).astype(np.uint64), base))
                   for p in np.linspace(0, 0.3, 60)), key=len)
    forest = jaccard.linked(sets, [0] * len(sets), 75)
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert len({forest.root(i) for i in range(len(sets))}) == len(set(up))


def test_empty_table_and_extra_columns(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f", 1, None), (2, "A b c d e f", 2, "k"), (3, None, 3, None)]
    docs = frame(spark, rows, "doc_id bigint, text string, node int, component_id string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("names", [[None, None, None, None], [7, 7, 7, 7], [None, 7, None, 7]])
def test_one_of_each_class_whatever_the_ids(spark, names):
    held = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "A b c d e f g"]
    kept = [r.text for r in jaccard.keep_one(frame(spark, list(zip(names, held)))).collect()]
    assert len(kept) == 3 and {t.lower() for t in kept} == set(held[:3])


def test_texts_of_one_short_hash_are_told_apart(spark):
    numbered = spark.range(300_000).selectExpr("concat('n', id, ' of many unlike texts here') AS text")
    pair = numbered.groupBy(F.hash("text")).agg(F.collect_list("text").alias("both")).where("size(both) > 1").first().both
    docs = frame(spark, [(None, t) for t in pair])
    assert sorted(r.text for r in jaccard.keep_one(docs).collect()) == sorted(pair)


@pytest.mark.parametrize("many", [255, 3])
def test_shingles_that_share_a_key(monkeypatch, many):
    """A text and its first three quarters, in one bucket, where a few shingles share keys."""
    monkeypatch.setattr(jaccard, "MANY", many, raising=False)
    words = [f"w{i}" for i in range(20_004)]
    held = [" ".join(words), " ".join(words[:15_004])]
    texts_of = pa.RecordBatch.from_arrays([pa.array(held)], ["text"])
    postings = jaccard._postings(5, np.zeros(0, np.uint64), 1, iter([texts_of]))
    lists = jaccard._lists(np.zeros(0, np.uint32), 1, postings)
    ties = list(jaccard._ties(75, jaccard._short_lists(75, 1, lists)))
    assert sum(b.num_rows for b in ties) == 1
