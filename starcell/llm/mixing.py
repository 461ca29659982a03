"""Mixing sources to target weights: a token budget passed down a tree of groups.

The tree has one level per given column (domain, language, source). Each node's budget is
shared among its children by their weights. A child that cannot use its share, because
its documents, repeated as often as allowed, hold fewer tokens, takes all it has, and the
rest goes to its siblings by their weights; only what all children of a node cannot use
counts as that node's own shortage, which its siblings take up. This is water-filling, top
down, with each subtree's capacity as a bound, and closed windows over siblings compute it.

Each leaf then takes whole epochs and, of one more, the prefix of a seeded order whose
tokens fit. The prefix is found without sorting a leaf: token sums per leaf and order
digit say in which digit the cut lies, and only the documents of that digit are ordered.
Everything is DataFrame work; no Python runs on rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcell.llm.shared import stored
from starcell.plans.sizing import broadcast_if_small

NONE = "(none)"
SEPARATOR = "\x1f"
# Documents that one order digit of a leaf should hold; there are as many digits as that takes.
ROWS_PER_DIGIT = 20_000
MAX_DIGITS = 8


@dataclass(frozen=True)
class Tree:
    """Levels (name -> column), weights by path, and the weight of nodes that have none.

    Weights are relative among siblings: a path with weight 0 gets nothing.
    """

    levels: Mapping[str, Column]
    weights: Mapping[tuple[str, ...], float]
    other: float = 1.0

    def __post_init__(self):
        values = [*self.weights.values(), self.other]
        if not self.levels or any(not (0 <= w < math.inf) for w in values):
            raise ValueError("a tree needs levels, and weights that are finite and not negative")

    def path(self, depth: int) -> Column:
        return F.concat_ws(SEPARATOR, *[F.coalesce(c.cast("string"), F.lit(NONE))
                                        for c in list(self.levels.values())[:depth]])

    def weight(self, path: Column) -> Column:
        if not self.weights:
            return F.lit(float(self.other))
        known = F.create_map(*[F.lit(x) for p, w in self.weights.items()
                               for x in (SEPARATOR.join(p), float(w))])
        return F.coalesce(F.try_element_at(known, path), F.lit(float(self.other)))


def water_filled(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Adds `share` to siblings (path, weight, capacity) of a parent with `budget`."""
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy("__full_at", "path")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (nodes.withColumn("__full_at", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
                             .otherwise(F.lit(float("inf"))))
            .withColumn("__level", F.when(F.col("weight") > 0, (F.col("budget") - before) / weights_left))
            .withColumn("__level", F.max(F.when(F.col("__full_at") > F.col("__level"), F.col("__level")))
                        .over(siblings))
            .withColumn("share", F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(
                F.least("capacity", F.coalesce(F.col("__level") * F.col("weight"), F.col("capacity")))))
            .drop("__full_at", "__level"))


def leaf_targets(leaves: DataFrame, tree: Tree, budget: float, epochs: int) -> DataFrame:
    """Tokens each leaf (path, have) is to give: `target`, of `have * epochs` at most."""
    depth = len(tree.levels)
    shares = None
    leaves = leaves.withColumn("capacity", F.col("have").cast("double") * epochs)
    for d in range(1, depth + 1):
        at = lambda n: F.substring_index("path", SEPARATOR, n)
        nodes = (leaves.groupBy(at(d).alias("node")).agg(F.sum("capacity").alias("capacity"))
                 .select(F.col("node").alias("path"), "capacity")
                 .withColumn("weight", tree.weight(F.col("path"))))
        if shares is None:
            nodes = nodes.withColumn("parent", F.lit("")).withColumn("budget", F.lit(float(budget)))
        else:
            nodes = nodes.withColumn("parent", at(d - 1)).join(shares, "parent")
        filled = water_filled(nodes, ["parent"])
        shares = filled.select(F.col("path").alias("parent"), F.col("share").alias("budget"))
    return leaves.drop("capacity").join(
        shares.select(F.col("parent").alias("path"), F.floor(F.col("budget") + 1e-6).alias("target")), "path")


def _order(seed: int) -> Column:
    """A document's place in the epoch after its leaf's whole ones."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), name))


def plan(docs: DataFrame, tree: Tree, tokens: Column, share: float, epochs: int = 1,
         seed: int = 0) -> DataFrame:
    """Per leaf: path, have, target, whole (epochs), rest (tokens) and `cut`, the last order value kept."""
    if not (0 < share and epochs >= 1):
        raise ValueError("share must be above 0 and epochs at least 1")
    slim = stored(docs.select("doc_id", tree.path(len(tree.levels)).alias("path"),
                              F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens")), "mixing-rows")
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    leaves = slim.groupBy("path").agg(F.sum("tokens").alias("have"))
    whole = F.when(F.col("have") > 0, F.floor(F.col("target") / F.col("have"))).otherwise(0)
    targets = stored(leaf_targets(leaves, tree, share * total, epochs)
                     .withColumn("whole", F.least(whole, F.lit(epochs)).cast("int"))
                     .withColumn("rest", F.col("target") - F.col("whole") * F.col("have")), "mixing-targets")

    digits = min(MAX_DIGITS, max(1, math.ceil(math.log(max(1, rows / ROWS_PER_DIGIT), 16))))
    placed = (slim.join(broadcast_if_small(targets.select("path", "whole", "rest")), "path")
              .withColumn("place", _order(seed)).withColumn("digit", F.substring("place", 1, digits)))
    sums = placed.groupBy("path", "digit").agg(F.first("rest").alias("rest"), F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("path").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    cut_digits = (sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
                  .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tokens") > F.col("rest")))
                  .select("path", "digit", "before"))
    cut_digits = stored(cut_digits, "mixing-digits")
    # Rows of the same doc_id share a place and go together.
    at_cut = (placed.join(broadcast_if_small(cut_digits), ["path", "digit"])
              .groupBy("path", "digit", "place").agg(
                  F.first("rest").alias("rest"), F.first("before").alias("before"), F.sum("tokens").alias("tokens")))
    so_far = Window.partitionBy("path", "digit").orderBy("place")
    cuts = (at_cut.withColumn("upto", F.col("before") + F.sum("tokens").over(so_far))
            .where("upto <= rest").groupBy("path").agg(F.max("place").alias("last")))
    # A leaf without a cut digit keeps the rest of its epoch; a digit with no row that fits keeps what is before it.
    return stored(targets.join(cut_digits, "path", "left").join(cuts, "path", "left")
                  .withColumn("cut", F.when(F.col("digit").isNull(), F.lit("~"))
                              .otherwise(F.coalesce("last", "digit")))
                  .select("path", "have", "target", "whole", "rest", "cut"), "mixing-plan")


def mix(docs: DataFrame, tree: Tree, tokens: Column, share: float, epochs: int = 1,
        seed: int = 0) -> DataFrame:
    """Rows of `docs`, each as often as the plan takes it, with `__epoch` counting from 0.

    The budget is `share` of all tokens. Null levels form a group named "(none)", null
    texts have no tokens, rows with the same doc_id (null included) of a leaf are taken or
    left together, and an empty table gives an empty result. Columns of the input are kept
    as they are; names that start with two underscores are reserved. Documents of one leaf
    are never gathered: the plan has a row per leaf, and rows are filtered where they lie.
    """
    leaves = plan(docs, tree, tokens, share, epochs, seed).select(
        F.col("path").alias("__path"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    held = docs.withColumn("__path", tree.path(len(tree.levels)))
    held = held.join(broadcast_if_small(leaves), "__path")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), name))
    copies = (F.col("__whole") + F.when((F.col("__whole") < epochs) & (place <= F.col("__cut")), 1).otherwise(0))
    return (held.withColumn("__copies", copies).where("__copies > 0")
            .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
            .drop("__path", "__whole", "__cut", "__copies"))
