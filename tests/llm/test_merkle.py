"""The manifest against a tree built in one list, with superblocks so small that there are many passes."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from starcell.llm import merkle
from tests.llm.samples import frame, same, texts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf int, root string"


def plain(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return plain(*map(field, (row[0], row[3], row[2], row[4], text)))


def climbed(nodes):
    """All levels of one tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([plain(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def beside(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append((nodes[first:at], nodes[at + 1:first + 3]))
        at //= 3
    return out


def cut(row):
    return row[1] if row[1] is None or row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 else row[1].replace("\n", "")


def audited(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {s: climbed([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = climbed([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = beside(trees[s], i) + beside(top, k)
            now = leaf_of(row, cut(row))
            for left, right in steps:
                now = plain(*left, now, *right)
            proof = plain(*[h for left, right in steps for h in (*left, *right)])
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def some_rows():
    held = [(i, t, ["en", None, "de"][n % 3], ["big", "big", "é", None, "", "-"][n % 6], None if n % 5 else n)
            for n, (i, t) in enumerate(texts(6))]
    held += [(1000 + i, f"line {i}\nnext\n", "en", "big", i) for i in range(200)]
    held += [(2**60 + 1, "large\nid", "en", "big", 1), (5000, "alone\n", "fr", "lone", 6), held[0], held[0]]
    return [(*row, 7, "clash") for row in held]


def tampered():
    return {"text": F.coalesce(F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
                                      F.replace("text", F.lit("\n"), F.lit(""))), "text")}


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_audit(spark, depth):
    rows = some_rows()
    got = merkle.audit(frame(spark, rows, SCHEMA), tampered=tampered(), depth=depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = got.collect()
    same(found, audited(rows))
    assert 0 < sum(r.verified for r in found) < len(found)


@pytest.mark.parametrize("rows", [[], some_rows()[:1], [r for r in some_rows() if r[3] == "big"]])
def test_few_trees(spark, rows):
    same(merkle.audit(frame(spark, rows, SCHEMA), tampered=tampered(), depth=2).collect(), audited(rows))


def test_proofs_fold_to_the_root_and_only_with_their_leaf(spark):
    rows = some_rows()
    found = merkle.audit(frame(spark, rows, SCHEMA), depth=2, with_proofs=True).collect()
    assert all(r.verified for r in found)
    for r in found:
        assert merkle.fold(r.leaf, r.lefts, r.rights) == r.root
        assert plain(*[x for pair in zip(r.lefts, r.rights) for x in pair]) == r.proof_sha256
        assert merkle.fold(merkle.digest(r.leaf), r.lefts, r.rights) != r.root


def test_many_groups(spark):
    rows = [(i, "t", "en", f"s{i:03}", 1, 0, "") for i in range(150)]
    same(merkle.audit(frame(spark, rows, SCHEMA), tampered=tampered(), depth=2).collect(), audited(rows))
