import hashlib
import math
import random

from pyspark.sql import functions as F

from starcell.llm import mixing

WEIGHTS = {("web",): 3.0, ("books",): 1.0, ("none",): 0.0, ("web", "en"): 2.0}


def tree():
    return mixing.Tree({"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}, WEIGHTS)


def rows_of(seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["web", "web", "books", "none", None]), r.choice(["en", "de", None]), r.choice("pqr"),
             "x" * r.choice([0, 5, 40, 400])) for i in range(300)]
    return [*rows, rows[5], (None, "web", "en", "p", "xy"), (900, "web", "en", "p", None)]


def shared(budget, kids, caps, weights):
    """Water-filling, one full child at a time."""
    left, out = dict.fromkeys(k for k in kids if weights[k] > 0), {k: 0.0 for k in kids}
    while left:
        level = budget / sum(weights[k] for k in left)
        full = [k for k in left if caps[k] <= level * weights[k]]
        if not full:
            return out | {k: level * weights[k] for k in left}
        k = min(full, key=lambda k: caps[k] / weights[k])
        out[k] = caps[k]
        budget -= caps[k]
        del left[k]
    return out


def brute(rows, share, epochs, seed):
    tokens = lambda t: len(t or "")
    path = lambda r: tuple(x or mixing.NONE for x in r[1:4])
    have = {}
    for r in rows:
        have[path(r)] = have.get(path(r), 0) + tokens(r[4])

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: math.floor(budget + 1e-6)}
        kids = sorted({p[:len(prefix) + 1] for p in have if p[:len(prefix)] == prefix})
        caps = {k: epochs * sum(n for p, n in have.items() if p[:len(k)] == k) for k in kids}
        out = {}
        for k, b in shared(budget, kids, caps, {k: WEIGHTS.get(k, 1.0) for k in kids}).items():
            out |= down(k, b)
        return out

    picked = []
    for leaf, target in down((), share * sum(have.values())).items():
        whole = min(epochs, target // have[leaf]) if have[leaf] else 0
        rest, own = target - whole * have[leaf], [r for r in rows if path(r) == leaf]
        picked += [(r[0], e) for r in own for e in range(whole)]
        place = lambda r: hashlib.md5(f"{seed}:{whole}:{mixing.NONE if r[0] is None else r[0]}".encode()).hexdigest()
        if whole < epochs:
            for at in sorted({place(r) for r in own}):
                group = [r for r in own if place(r) == at]
                rest -= sum(tokens(r[4]) for r in group)
                if rest < 0:
                    break
                picked += [(r[0], whole) for r in group]
    return sorted(picked, key=repr)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_DIGIT", 8)
    for seed, share, epochs in ((1, 0.5, 1), (2, 0.9, 2), (3, 5.0, 2)):
        rows = rows_of(seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, text string")
        got = mixing.mix(docs, tree(), F.octet_length("text"), share, epochs, seed)
        assert got.columns == [*docs.columns, "__epoch"]
        assert sorted([(r.doc_id, r["__epoch"]) for r in got.collect()], key=repr) == brute(rows, share, epochs, seed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, domain string, lang string, source string, text string")
    assert mixing.mix(docs, tree(), F.octet_length("text"), 0.5).count() == 0
