"""Merkle manifest of a dataset: a digest per row, per group and of the whole, with proofs.

Rows become leaves, and every `FANOUT` consecutive leaves of a group one node, level by
level, until one is left, the group's subroot; subroots in the order of their groups make
the root the same way. Trees are cut into superblocks of `FANOUT ** depth` nodes. Going up,
a superblock is reduced in one task to the node above it, and these nodes are the leaves of
the next pass, so that no task holds more than a superblock at any size. Going down, the
rows of a superblock are cogrouped with the one row of outer nodes (the siblings on the way
from the superblock to the root) that they need; one function finishes the reduction inside,
joins the inner and outer siblings to proofs, and folds each proof.

Leaves are numbered by a range sort whose parts are stored, so a group that holds most rows
is spread over many tasks, and a lost executor re-reads what the others agreed on.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.llm.shared import stored
from starcell.plans.ordering import sorted_parts
from starcell.plans.sizing import broadcast_if_small

FANOUT = 3
# Levels inside a superblock: 729 leaves are reduced, proved and folded together.
DEPTH = 6

_NODES = "tree string, pos bigint, total bigint, node binary"
_PATHS = "tree string, pos bigint, lefts array<string>, rights array<string>, subroot string, root string"
_AUDIT = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, lefts array<string>, rights array<string>")


def digest(*parts: str) -> str:
    """H: the hex sha256 of texts in a row."""
    return sha256("".join(parts).encode()).hexdigest()


def encoded(column: Column) -> Column:
    """A value with its length in bytes before it, `-` for null, so that no two rows run together alike."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def levels(nodes: list[str], total: int, depth: int) -> list[list[str]]:
    """The nodes of a superblock, level by level, up to `depth` levels or the top of its tree.

    `nodes` start at a multiple of FANOUT ** depth; `total` counts all nodes of their level in the tree.
    """
    out = [nodes]
    while total > 1 and len(out) <= depth:
        below = out[-1]
        out.append([digest(*below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
        total = -(-total // FANOUT)
    return out


def siblings(held: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's ancestors in their runs, level by level within the block."""
    lefts, rights = [], []
    for nodes in held[:-1]:
        first = at - at % FANOUT
        lefts.append("".join(nodes[first:at]))
        rights.append("".join(nodes[at + 1:first + FANOUT]))
        at //= FANOUT
    return lefts, rights


def fold(leaf: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(lefts, rights):
        leaf = digest(left, leaf, right)
    return leaf


def _hex(column: pd.Series) -> list[str]:
    return [bytes(b).hex() for b in column]


def _reduced(depth: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        total = int(block["total"].iloc[0])
        top = levels(_hex(block["node"]), total, depth)[-1][0]
        for _ in range(depth):
            total = -(-total // FANOUT)
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [int(block["pos"].iloc[0]) // FANOUT ** depth],
                             "total": [total], "node": [bytes.fromhex(top)]})

    return run


def _handed_down(depth: int):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        above = outer.iloc[0]
        held = levels(_hex(block["node"]), int(block["total"].iloc[0]), depth)
        inner = [siblings(held, i) for i in range(len(block))]
        return pd.DataFrame({
            "tree": block["tree"], "pos": block["pos"],
            "lefts": [[*left, *above.lefts] for left, _ in inner], "rights": [[*right, *above.rights] for _, right in inner],
            "subroot": above.subroot, "root": above.root})

    return run


def _audited(depth: int, with_proofs: bool):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        above = outer.iloc[0]
        leaves, given = _hex(block["node"]), _hex(block["given"])
        held = levels(leaves, int(block["total"].iloc[0]), depth)
        rows = []
        for i, (row, leaf, now) in enumerate(zip(block["doc_id"], leaves, given)):
            lefts, rights = siblings(held, i)
            lefts, rights = [*lefts, *above.lefts], [*rights, *above.rights]
            proof = digest(*[part for pair in zip(lefts, rights) for part in pair])
            folded = fold(now, lefts, rights)
            rows.append((row, leaf, above.subroot, above.root, proof, folded, folded == above.root,
                         *((lefts, rights) if with_proofs else (None, None))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _AUDIT.split(", ")])

    return run


def _in_blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FANOUT ** depth}"))


def _passes(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes of each pass, from the leaves to one node per tree."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        up = (_in_blocks(out[-1].select("tree", "pos", "total", "node"), depth)
              .groupBy("tree", "block").applyInPandas(_reduced(depth), _NODES))
        out.append(stored(up, "merkle-nodes"))
    return out


def _paths(passes: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """_PATHS of the nodes of the second pass (the superblocks of the first), from those of the trees' tops."""
    outer = tops
    for nodes in reversed(passes[1:-1]):
        held = _in_blocks(nodes, depth).groupBy("tree", "block")
        down = held.cogroup(_above(outer)).applyInPandas(_handed_down(depth), _PATHS)
        outer = stored(down, "merkle-paths")
    return outer


def _above(outer: DataFrame):
    return outer.withColumnRenamed("pos", "block").groupBy("tree", "block")


def _numbered(rows: DataFrame, order: Sequence) -> DataFrame:
    """Adds `pos` (from 0 within the tree, in the order of rows) and `total` (rows of the tree)."""
    placed = sorted_parts(rows, order).withColumn("at", F.col("__rows_before") + F.col("__place"))
    placed = placed.drop("__rows_before", "__place", "__part")
    trees = stored(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total")),
                   "merkle-trees")
    return (placed.join(broadcast_if_small(trees), "tree")
            .withColumn("pos", F.col("at") - F.col("first")).drop("at", "first"))


def audit(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
          group: str = "source", tampered: dict[str, Column] | None = None, depth: int = DEPTH,
          with_proofs: bool = False) -> DataFrame:
    """Per row of `docs` its `doc_id`, leaf, subroot, root, proof and what a tampered row folds to.

    `tampered` gives columns (by field) as they are found now; `folded_root` comes from the leaf
    of these and the original siblings, and `verified` says whether it is the root. With
    `with_proofs` the siblings themselves follow, per level those on the left (`lefts`) and on
    the right (`rights`), as one text each.

    A null value is a field `-` and an empty text `0:`. A null group comes before all others,
    a null doc_id before all others of its group; rows that share a doc_id stand in the order
    of their leaves, and equal rows are leaves of their own. A row alone is its own root, with
    the digest of an empty text as its proof; an empty table gives an empty result. Texts are
    digested where they are read, whole and of any length; only digests are shuffled. Other
    columns of the input are not looked at.
    """
    now = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = stored(docs.select(
        tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(leaf_digest([F.col(f) for f in fields])).alias("node"),
        F.unhex(leaf_digest([now[f] for f in fields])).alias("given")), "merkle-leaves")
    leaves = stored(_numbered(leaves, ["tree", "doc_id", "node"]), "merkle-numbered")
    inner = _passes(leaves, depth)

    # Subroots are the leaves of one more tree.
    tops = inner[-1].select("tree", F.col("node").alias("sub"))
    outer = stored(_numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"),
                                         F.col("sub").alias("node")), ["name"]), "merkle-subroots")
    upper = _passes(outer, depth)
    root = upper[-1].select("tree", F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("lefts"),
                            F.array().cast("array<string>").alias("rights"), F.lit("").alias("subroot"),
                            F.lower(F.hex("node")).alias("root"))
    above = _paths(upper, root, depth)
    if len(upper) > 1:
        above = stored(_in_blocks(outer, depth).groupBy("tree", "block").cogroup(_above(above))
                       .applyInPandas(_handed_down(depth), _PATHS), "merkle-paths")
    named = outer.select("pos", F.col("name").alias("tree"), F.lower(F.hex("node")).alias("subroot"))
    tops = named.join(above.select("pos", "lefts", "rights", "root"), "pos").select(
        "tree", F.lit(0).cast("bigint").alias("pos"), "lefts", "rights", "subroot", "root")
    tops = stored(tops, "merkle-tops")

    below = _above(_paths(inner, tops, depth))
    # A tree of one leaf has no pass above it; its block is its top.
    held = _in_blocks(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), depth).groupBy("tree", "block")
    found = held.cogroup(below).applyInPandas(_audited(depth, with_proofs), _AUDIT)
    found = found.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return found if with_proofs else found.drop("lefts", "rights")
