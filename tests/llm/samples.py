"""Rows with nulls, empty and long texts, repeats and clashing columns, made from a seed."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed: int, n: int = 60) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, junk, and odd rows at the end."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ünd", "été", "漢字", "don't", "a,b", "#", "it's."]
    passages = [" ".join(r.choice(vocabulary) for _ in range(70)) for _ in range(3)]
    out: list[tuple] = []
    while len(out) < n:
        kind = r.random()
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 4, 5, 9, 30, 120]))]
        if kind < 0.3 and out:
            words = WORD.findall(r.choice(out)[1])
            for _ in range(r.choice([0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif kind < 0.5:
            words.insert(r.randrange(len(words)), r.choice(passages))
        elif kind < 0.6:
            words = words[:3] * 20
        sep = r.choice([" ", " ", "\n", "  ", "\t"])
        out.append((len(out), sep.join(words)))
    long = " ".join(r.choice(vocabulary) for _ in range(12_000))
    return [*out, out[3], out[3], (None, out[4][1]), (None, None), (n + 1, None), (n + 2, ""), (n + 3, " \n\t "),
            (n + 4, "x" * 5000), (n + 5, long), (n + 6, out[5][1].upper())]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def same(got, want) -> None:
    got, want = (sorted(map(tuple, x), key=repr) for x in (got, want))
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want) if a != b]
    assert not off, off[:3]
