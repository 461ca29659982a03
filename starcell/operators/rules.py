"""Association rules over categorical profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.functions.labels import rule_strength
from starcell.functions.numeric import round_half_up
from starcell.plans.marts import PLAN_COLUMNS
from starcell.plans.sizing import broadcast_if_small
from starcell.session import write_and_read

TARGET = "Churn=Yes"


def item_array(columns: Mapping[str, Column]) -> Column:
    """Sorted distinct `name=value` items; a NULL value gives no item."""
    items = [F.concat(F.lit(f"{name}="), column.cast("string")) for name, column in columns.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*items))))


def transactions(rows: DataFrame, columns: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One item set per row."""
    return rows.select(*keys, item_array(columns).alias("items"))


def baskets(rows: DataFrame, columns: Mapping[str, Column], weight: Column | None = None) -> DataFrame:
    """Distinct item sets with how many rows have each.

    Equal profiles are counted before any item combination is made, so the work
    that follows grows with the number of distinct profiles, not with the rows.
    """
    weight = F.lit(1) if weight is None else weight
    named = rows.select(*[c.alias(n) for n, c in columns.items()], weight.alias("__weight"))
    counted = named.groupBy(*columns).agg(F.sum("__weight").alias("weight"))
    return counted.select(item_array({n: F.col(n) for n in columns}).alias("items"), "weight")


def churn_baskets(fact: DataFrame, plan: DataFrame) -> DataFrame:
    """Baskets of the customer mart: 12 plan attributes and churn.

    The fact is counted per plan and flag first; only those counts meet the plans.
    """
    counts = fact.groupBy("plan_key", "churn_flag").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(broadcast_if_small(plan), "plan_key")
    churn = F.when(F.col("churn_flag") == 1, "Yes").otherwise("No")
    return baskets(rows, {**{c: F.col(c) for c in PLAN_COLUMNS}, "Churn": churn}, F.col("n"))


def _longer(classes: DataFrame) -> DataFrame:
    """Sets of one more item: in a class of a basket's sets that differ in the last item only, any two join."""
    one = classes.select("basket", "weight", "begin", "lasts", F.posexplode("lasts").alias("at", "last"))
    rest = F.slice("lasts", F.col("at") + 2, F.size("lasts"))
    return one.select("basket", "weight", F.array_append("begin", F.col("last")).alias("begin"),
                      F.explode(rest).alias("last"))


def frequent_itemsets(counted: DataFrame, min_support: float = 0.05, max_items: int = 3) -> DataFrame:
    """Item sets up to `max_items` held by at least a share `min_support` of all rows.

    `counted` holds (items, weight). Sets grow by one item at a time: a basket keeps those
    of its sets that are frequent, found by a join, in classes that share all but the last
    item; longer sets are the pairs within a class. A class has at most the items of one
    basket. Counting combines map-side, and no list of items leaves the cluster.
    """
    min_support = arguments.number(min_support, "min_support", 0.0, 1.0)
    max_items = arguments.whole_number(max_items, "max_items", 1)
    # Stored, so that the numbers of baskets stay.
    baskets_of = write_and_read(counted.groupBy("items").agg(F.sum("weight").alias("weight")).withColumn(
        "basket", F.monotonically_increasing_id()), "baskets")
    size = baskets_of.agg(F.sum("weight")).first()[0] or 0
    share = F.col("row_count") / F.lit(float(size))
    held = baskets_of.select("basket", "weight", F.array().cast("array<string>").alias("begin"),
                             F.explode(F.array_distinct("items")).alias("last"))
    found = None
    for length in range(1, max_items + 1):
        counts = held.groupBy("begin", "last").agg(F.sum("weight").alias("row_count"))
        frequent = write_and_read(counts.where(share >= min_support), "frequent")
        found = frequent if found is None else found.unionByName(frequent)
        if length < max_items:
            kept = held.join(frequent.select("begin", "last"), ["begin", "last"])
            classes = kept.groupBy("basket", "begin").agg(
                F.first("weight").alias("weight"), F.array_sort(F.collect_list("last")).alias("lasts"))
            classes = classes.where(F.size("lasts") > 1)
            # Read twice, but for those that only the last counts need.
            held = _longer(write_and_read(classes, "classes") if length + 1 < max_items else classes)
    itemset = F.array_append("begin", F.col("last"))
    return found.select(itemset.alias("itemset"), F.size(itemset).alias("items"), "row_count", share.alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.35, min_lift: float = 1.2,
                      target: str | None = TARGET) -> DataFrame:
    """Rules with one consequent item, ranked by lift, then confidence.

    Limits are tested on the exact values; output has four decimals.
    """
    min_confidence = arguments.number(min_confidence, "min_confidence", 0.0, 1.0)
    min_lift = arguments.number(min_lift, "min_lift", 0.0)
    itemsets = write_and_read(itemsets, "itemsets")
    split = itemsets.where("items >= 2").select(
        "itemset", "support", F.explode("itemset").alias("consequent"))
    if target is not None:
        split = split.where(F.col("consequent") == target)
    split = split.withColumn("__left", F.array_except("itemset", F.array("consequent")))
    left = itemsets.select(F.col("itemset").alias("__left"), F.col("support").alias("left_support"))
    right = itemsets.where("items = 1").select(
        F.col("itemset")[0].alias("consequent"), F.col("support").alias("right_support"))
    rules = split.join(left, "__left").join(right, "consequent")
    rules = rules.withColumn("conf", F.col("support") / F.col("left_support"))
    rules = rules.withColumn("raw_lift", F.col("conf") / F.col("right_support"))
    rules = rules.where((F.col("conf") >= min_confidence) & (F.col("raw_lift") >= min_lift))
    rules = rules.select(
        F.array_join(F.array_sort("__left"), " & ").alias("antecedent"), "consequent",
        round_half_up("support", 4).alias("support"),
        round_half_up("conf", 4).alias("confidence"),
        round_half_up("raw_lift", 4).alias("lift"),
        round_half_up("left_support", 4).alias("antecedent_support"),
        round_half_up("right_support", 4).alias("consequent_support"))
    return ranked(rules.dropDuplicates(["antecedent", "consequent"]))


def ranked(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent")


def _wanted(rules: DataFrame, target: str | None, min_confidence: float) -> DataFrame:
    bound = arguments.number(min_confidence, "min_confidence", 0.0, 1.0)
    rows = rules.where(F.col("confidence") >= bound)
    if target is not None:
        rows = rows.where(F.replace("consequent", F.lit(" "), F.lit("")) == target.replace(" ", ""))
    return rows


def query_rules(rules: DataFrame, target: str | None = TARGET, min_confidence: float = 0.5,
                limit: int | None = None) -> DataFrame:
    """The rules that reach a confidence, by lift; `limit` keeps the strongest."""
    found = ranked(_wanted(rules, target, min_confidence))
    return found if limit is None else found.limit(arguments.whole_number(limit, "limit", 1))


def query_totals(rules: DataFrame, target: str | None = TARGET, min_confidence: float = 0.5,
                 limit: int | None = None) -> DataFrame:
    """How many rules exist and how many `query_rules` returns, in one row."""
    most = 2**63 - 1 if limit is None else arguments.whole_number(limit, "limit", 1)
    hits = _wanted(rules.withColumn("__hit", F.lit(1)), target, min_confidence)
    both = rules.select(F.lit(0).alias("__hit")).unionByName(hits.select("__hit"))
    return both.agg(F.count_if(F.col("__hit") == 0).alias("total_rules_available"),
                    F.least(F.count_if(F.col("__hit") == 1), F.lit(most)).cast("bigint").alias(
                        "filtered_rules_count"))


def search_rules(rules: DataFrame, words: str) -> DataFrame:
    """Rules whose antecedent contains the words, in any case."""
    return ranked(rules.where(F.lower("antecedent").contains(str(words).lower())))


def with_strength(rules: DataFrame) -> DataFrame:
    return rules.withColumn("strength", rule_strength("lift"))
