"""Mining queries (SURVEY groups E, F) over the loaded marts, with SQL where it can say it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from driver.raw import STAGED_CUSTOMER_SQL, raw_customer, warehouse
from driver.sql import KPIS, LINE_DIGITS, LINES, OBS, avg, rnd
from driver.tables import customer_star, line_kpis, network_star, sites, table
from starcell.functions.numeric import round_half_up
from starcell.functions.timeparts import stamp_text
from starcell.operators import churn, clusters, features, kmeans, loading, quality, results, rules, silhouette
from starcell.plans import measures
from starcell.plans.marts import PLAN_COLUMNS
from starcell.session import fresh_path, write_and_read
from starcell.sources import files

MONEY = {"tenure": 0, "monthly_charges": 2, "total_charges": 2}
SITE_KPIS = ("latency_ms", "throughput_mbps", "call_drop_rate_pct")
RULE_LIMITS = {"min_support": 0.05, "min_confidence": 0.35, "min_lift": 1.2}


def modelling(s, d):
    house = warehouse(s, d)
    return churn.modelling_table(*(house.read(t) for t in
                                   ("fact_customer_churn", "dim_customer", "dim_plan")))


def split(s, d):
    return churn.stratified_split(modelling(s, d), "churn_flag", "customerID")


def predictions(s, d):
    """A fixed score without a model: cheap accounts churn, ties on purpose."""
    score = F.floor(F.lit(100) - F.least(F.col("monthly_charges") / 5000, F.lit(100.0))) / 100
    rows = split(s, d).where("split = 'test'").select("churn_flag", score.alias("probability"))
    return rows.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0))


def given_evaluation(s, d):
    """The evaluation of two scores that need no model: cheap accounts churn, or new ones."""
    rows = split(s, d).where("split = 'test'")
    scores = {"logistic_regression": F.floor(F.lit(100) - F.least(F.col("monthly_charges") / 5000, F.lit(100.0))) / 100,
              "decision_tree": F.lit(1.0) - F.col("tenure") / F.lit(100.0)}
    return churn.evaluate({
        name: rows.select("churn_flag", p.alias("probability"), F.when(p >= 0.5, 1).otherwise(0).alias("prediction"))
        for name, p in scores.items()})


def scaled(s, d):
    """Numerics of both splits, scaled with the training rows' statistics."""
    rows = write_and_read(split(s, d), "split")
    scaling = features.Scaling.fit(rows.where("split = 'train'"), MONEY)
    return scaling.apply(rows.select("customerID", "split", *MONEY)).withColumns(
        {n: round_half_up(n, 6) for n in MONEY})


def encoded(s, d):
    """Encoded categories of both splits, summed per split and column."""
    rows = write_and_read(split(s, d), "split")
    encoder = features.Preprocessor.fit(rows.where("split = 'train'"), {}, churn.CATEGORICAL)
    sums = encoder.apply(rows, ["split"]).groupBy("split").agg(Summarizer.sum(F.col("features")).alias("sums"))
    ones = sums.select("split", F.posexplode(vector_to_array("sums")).alias("place", "ones"))
    return ones.join(encoder.names(), "place").select("split", "feature", F.col("ones").cast("bigint").alias("ones"))


def class_weights(s, d):
    rows = modelling(s, d)
    weighted = churn.with_weights(rows, churn.balanced_weights(rows))
    return weighted.groupBy("churn_flag").agg(F.count(F.lit(1)).alias("row_count"),
                                              round_half_up(F.max("weight"), 6).alias("weight"))


@lru_cache(maxsize=4)
def trained(s, d):
    """Both churn models, trained once per session."""
    return churn.train_models(modelling(s, d))


def logistic_scores(s, d):
    return churn.score(trained(s, d).logistic, trained(s, d).test)


def tree_scores(s, d):
    return churn.score(trained(s, d).tree, trained(s, d).test)


def persisted(s, d):
    """Save, load and score with what was loaded."""
    folder = fresh_path(s, "models")
    trained(s, d).save(s, folder)
    preprocessor, logistic, tree = churn.load_models(s, folder)
    rows = preprocessor.apply(modelling(s, d), ["churn_flag"])
    lines = [churn.confusion(churn.score(m, rows)).select(F.lit(n).alias("model"), "*")
             for n, m in (("logistic_regression", logistic), ("decision_tree", tree))]
    return lines[0].unionByName(lines[1])


def ranked_levels(s, d):
    """Ranks and directions over per-priority figures instead of a model's."""
    orders = table(s, d, "orders")
    share = F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))
    rows = orders.groupBy(F.col("o_orderpriority").alias("feature")).agg(
        round_half_up(share, 2).alias("dt_importance"),
        round_half_up((F.count_if(F.col("o_orderstatus") == "P") - F.count_if(F.col("o_orderstatus") == "O"))
                      / 100.0, 2).alias("lr_coefficient"))
    return churn.rank_features(rows)


def kpi_rows(s, d):
    rows = clusters.kpi_table(network_star(s, d))
    return rows.withColumn("timestamp", stamp_text("timestamp"))


def standardised(s, d):
    scaling = features.Scaling.fit(line_kpis(s, d), LINE_DIGITS)
    rows = scaling.apply(network_star(s, d).rows(["cell_id"]).select("cell_id", *KPIS))
    return rows.withColumns({k: round_half_up(k, 6) for k in KPIS})


LABEL_SQL = ("CASE WHEN call_drop_rate_pct > 8 THEN 0 WHEN latency_ms > 150 THEN 1 "
             "WHEN technology = 'O' THEN 2 ELSE 3 END")


def fixed_clusters(s, d):
    label = (F.when(F.col("call_drop_rate_pct") > 8, 0).when(F.col("latency_ms") > 150, 1)
             .when(F.col("technology") == "O", 2).otherwise(3))
    return line_kpis(s, d).withColumn("cluster_id", label)


def fixed_inertia(s, d):
    rows = fixed_clusters(s, d)
    return clusters.inertia(rows, {k: F.col(k) for k in KPIS}, "cluster_id")


@lru_cache(maxsize=4)
def kmeans_inputs(s, d):
    rows, _ = clusters.scaled_features(line_kpis(s, d), LINE_DIGITS)
    return write_and_read(rows, "kpi-features")


@lru_cache(maxsize=4)
def chosen_model(s, d):
    return clusters.best_model(kmeans_inputs(s, d), clusters.SELECTED_K)


@lru_cache(maxsize=4)
def sweep(s, d):
    return clusters.k_sweep(kmeans_inputs(s, d))


# Centres of a pass whose result SQL can say: equally spaced on the diagonal.
PASS_EDGE = 1.5


def lloyd_pass(s, d):
    """One shared pass of four models from fixed centres: sizes, inertia and the means that centres move to."""
    points, names = clusters.point_columns(kmeans_inputs(s, d))
    starts = [np.outer(np.linspace(-PASS_EDGE, PASS_EDGE, k), np.ones(len(names))) for k in clusters.K_RANGE]
    found, _ = kmeans.lloyd_pass(points, [kmeans.Model(c) for c in starts], names)
    rows = [(m.k, j, int(m.sizes[j]), m.inertia, *map(float, m.sums[j] / max(m.sizes[j], 1)))
            for m in found for j in range(m.k) if m.sizes[j]]
    kpis = ", ".join(f"{k} double" for k in KPIS)
    held = s.createDataFrame(rows, f"k int, cluster_id int, row_count bigint, inertia double, {kpis}")
    return held.select("k", "cluster_id", "row_count", round_half_up("inertia", 2).alias("inertia"),
                       *[round_half_up(k, 4).alias(k) for k in KPIS])


def fixed_assignment(s, d):
    """Rows of each technology per cluster, by four centres in a line."""
    rows = kmeans_inputs(s, d)
    names = [f"z_{k}" for k in KPIS]
    wide = rows.withColumn("z", vector_to_array("features"))
    wide = wide.select("*", *[F.col("z")[i].alias(n) for i, n in enumerate(names)])
    centres = np.outer(np.linspace(-PASS_EDGE, PASS_EDGE, 4), np.ones(len(names)))
    labelled = wide.withColumn("cluster_id", kmeans.nearest(names, kmeans.Model(centres)))
    return labelled.groupBy("technology", "cluster_id").agg(F.count(F.lit(1)).alias("row_count"))


def assigned(s, d):
    return clusters.assign(chosen_model(s, d), kmeans_inputs(s, d))


def silhouettes(s, d):
    """Squared-distance silhouette of the chosen clustering."""
    rows = chosen_model(s, d).transform(kmeans_inputs(s, d))
    value = clusters.squared_silhouette(rows)
    return s.createDataFrame([(clusters.SELECTED_K, float(value))], "k int, silhouette_score double")


def fixed_silhouette(s, d):
    """The same measure for fixed labels, which SQL can say."""
    rows, _ = clusters.scaled_features(fixed_clusters(s, d), LINE_DIGITS)
    value = clusters.squared_silhouette(rows.withColumn("cluster_id", F.col("cluster_id").cast("double")), "cluster_id")
    found = s.createDataFrame([(float(value),)], "silhouette_score double")
    return found.select(round_half_up("silhouette_score", 4).alias("silhouette_score"))


def euclidean(s, d):
    """Euclidean silhouette of the chosen clustering, with its error."""
    rows = chosen_model(s, d).transform(kmeans_inputs(s, d)).withColumn("z", vector_to_array("features"))
    names = [f"z_{k}" for k in KPIS]
    rows = rows.select("prediction", *[F.col("z")[i].alias(n) for i, n in enumerate(names)])
    return silhouette.euclidean_silhouette(rows, names, "prediction")


def site_silhouette(s, d):
    """How well regions part the sites by their mean KPIs: every site is compared with all sites."""
    means = line_kpis(s, d).groupBy("l_suppkey").agg(*[F.avg(k).alias(k) for k in SITE_KPIS])
    rows = means.join(sites(s, d), F.col("l_suppkey") == F.col("s_suppkey"))
    return silhouette.euclidean_silhouette(rows, SITE_KPIS, "region", sample=None)


def itemsets(s, d):
    house = warehouse(s, d)
    counted = rules.churn_baskets(house.read("fact_customer_churn"), house.read("dim_plan"))
    return rules.frequent_itemsets(counted, RULE_LIMITS["min_support"])


def itemset_texts(s, d):
    return itemsets(s, d).select(F.array_join("itemset", " & ").alias("itemset"), "items", "row_count",
                                 "support")


@lru_cache(maxsize=4)
def stored_rules(s, d):
    """Rules mined once per session and stored as the result file."""
    found = rules.association_rules(itemsets(s, d), RULE_LIMITS["min_confidence"], RULE_LIMITS["min_lift"])
    path = files.write_csv(found, fresh_path(s, "rules"))
    return files.read_result_csv(s, path, files.RULE_SCHEMA)


def line_rules(s, d):
    """Any consequent, over order lines with their order and part."""
    names = {"o_orderpriority": "contract", "o_orderstatus": "internet_service", "p_type": "payment_method",
             "l_linestatus": "line_status", "l_returnflag": "return_flag"}
    counts = customer_star(s, d).aggregate([measures.row_count("n")], list(names.values()))
    counted = rules.baskets(counts, {n: F.col(a) for n, a in names.items()}, F.col("n"))
    return rules.association_rules(rules.frequent_itemsets(counted, 0.01), 0.3, 1.0, target=None)


def stored_profiles(s, d):
    """Profiles of fixed labels, written as a result table and read again."""
    kept = results.Results(s, fresh_path(s, "results"))
    kept.write("cluster_profiles", clusters.cluster_profiles(fixed_clusters(s, d), digits=LINE_DIGITS))
    return kept.read("cluster_profiles")


def fixed_overview(s, d):
    """The overview of given scores, one K-Means pass and the rules, stored first."""
    kept = results.Results(s, fresh_path(s, "results"))
    kept.write("churn_metrics", given_evaluation(s, d))
    kept.write("clustering_metrics", lloyd_pass(s, d).select("k", "inertia").distinct())
    kept.write("association_rules", stored_rules(s, d))
    return results.overview(kept)


def stored_overview(s, d):
    """The overview read from stored metrics, sweep and rules."""
    kept = results.Results(s, fresh_path(s, "results"))
    kept.write("churn_metrics", trained(s, d).evaluation())
    kept.write("clustering_metrics", sweep(s, d))
    kept.write("association_rules", stored_rules(s, d))
    return results.overview(kept)


QUERIES = {
    "e1_modelling_table": modelling,
    "e2_feature_nulls": lambda s, d: quality.null_counts(
        modelling(s, d), churn.feature_columns(modelling(s, d).columns)),
    "e3_stratified_split": lambda s, d: split(s, d).select("customerID", "churn_flag", "split"),
    "e3_hashed_split": lambda s, d: churn.hashed_split(
        modelling(s, d), "customerID").select("customerID", "split"),
    "e4_class_distribution": lambda s, d: churn.class_distribution(split(s, d)),
    "e5_scaled_numerics": scaled,
    "e6_encoded_categories": encoded,
    "e7_class_weights": class_weights,
    "e8_logistic_scores": logistic_scores,
    "e9_tree_scores": tree_scores,
    "e10_evaluation": lambda s, d: trained(s, d).evaluation(),
    "e10_given_evaluation": given_evaluation,
    "e11_confusion": lambda s, d: churn.confusion(predictions(s, d)),
    "e12_metrics": lambda s, d: churn.classification_metrics(churn.confusion(predictions(s, d))),
    "e13_roc_auc": lambda s, d: churn.roc_auc(predictions(s, d)),
    "e13_roc_auc_by_parts": lambda s, d: churn.roc_auc(predictions(s, d).repartition(5)),
    "e14_feature_table": lambda s, d: trained(s, d).features(s),
    "e14_feature_ranks": ranked_levels,
    "e15_saved_models": persisted,
    "f1_kpi_table": kpi_rows,
    "f2_standardised_kpis": standardised,
    "f3_k_sweep": sweep,
    "f3_lloyd_pass": lloyd_pass,
    "f4_inertia": fixed_inertia,
    "f5_silhouette": silhouettes,
    "f5_fixed_silhouette": fixed_silhouette,
    "f5_euclidean_silhouette": euclidean,
    "f6_fixed_assignment": fixed_assignment,
    "f5_site_silhouette": site_silhouette,
    "f6_assigned_clusters": assigned,
    "f7_cluster_profiles": lambda s, d: clusters.cluster_profiles(
        fixed_clusters(s, d), digits=LINE_DIGITS),
    "f7_stored_profiles": stored_profiles,
    "f8_profiles_by_model": lambda s, d: clusters.cluster_profiles(assigned(s, d), digits=LINE_DIGITS),
    "f9_transactions": lambda s, d: rules.transactions(
        loading.stage_customer(raw_customer(s, d)),
        {**{c: F.col(c) for c in PLAN_COLUMNS},
         "Churn": F.when(F.col("churn_flag") == 1, "Yes").otherwise("No")}, ["customerID"]).select(
             "customerID", F.array_join("items", " & ").alias("items")),
    "f10_frequent_itemsets": itemset_texts,
    "f11_association_rules": stored_rules,
    "f11_rules_any_consequent": line_rules,
    "f13_rule_query": lambda s, d: rules.query_rules(stored_rules(s, d), min_confidence=0.5, limit=500),
    "f13_rule_totals": lambda s, d: rules.query_totals(stored_rules(s, d), limit=500),
    "f14_mining_overview": lambda s, d: clusters.mining_overview(
        s, trained(s, d).evaluation(), sweep(s, d), stored_rules(s, d)),
    "f14_stored_overview": stored_overview,
    "f14_fixed_overview": fixed_overview,
    "f15_rule_search": lambda s, d: rules.search_rules(stored_rules(s, d), "FIBER"),
    "f16_rule_strength": lambda s, d: rules.with_strength(stored_rules(s, d)),
}

_MODEL = f"""{STAGED_CUSTOMER_SQL},
model AS (SELECT customerID, gender, SeniorCitizen, Partner, Dependents, tenure,
  {", ".join(PLAN_COLUMNS)}, monthly_charges, total_charges, churn_flag, tenure_band FROM staged)"""

_SPLIT = f"""{_MODEL},
sizes AS (SELECT churn_flag, count(*) AS n FROM model GROUP BY churn_flag),
fair AS (SELECT *, ceil(sum(n) OVER () * 0.2::DOUBLE) AS want,
  ceil(sum(n) OVER () * 0.2::DOUBLE) * n / sum(n) OVER () AS fair FROM sizes),
quotas AS (SELECT churn_flag AS c, floor(fair) + CASE WHEN row_number() OVER (
    ORDER BY fair - floor(fair) DESC, churn_flag) <= want - sum(floor(fair)) OVER () THEN 1 ELSE 0 END AS quota
  FROM fair),
split AS (SELECT m.*, CASE WHEN row_number() OVER (PARTITION BY churn_flag
    ORDER BY md5(customerID || '42'), customerID) <= quota THEN 'test' ELSE 'train' END AS split
  FROM model m JOIN quotas ON churn_flag = c)"""

_PRED = f"""{_SPLIT},
guess AS (SELECT churn_flag, floor(100 - least(monthly_charges / 5000, 100.0::DOUBLE)) / 100 AS probability
  FROM split WHERE split = 'test'),
pred AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM guess)"""

_CONFUSION = """count(*) FILTER (churn_flag = 0 AND prediction = 0) AS true_negative,
  count(*) FILTER (churn_flag = 0 AND prediction = 1) AS false_positive,
  count(*) FILTER (churn_flag = 1 AND prediction = 0) AS false_negative,
  count(*) FILTER (churn_flag = 1 AND prediction = 1) AS true_positive"""


_METRICS = ", ".join(f"{rnd(f'coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0::DOUBLE)', 4)} AS {n}" for n, a, b in (
    ("accuracy", "true_positive + true_negative", "true_positive + true_negative + false_positive + false_negative"),
    ("precision", "true_positive", "true_positive + false_positive"),
    ("recall", "true_positive", "true_positive + false_negative"),
    ("f1_score", "2 * true_positive", "2 * true_positive + false_positive + false_negative")))

_GIVEN = f"""{_SPLIT},
scores AS (SELECT 'logistic_regression' AS model, churn_flag,
    floor(100 - least(monthly_charges / 5000, 100.0::DOUBLE)) / 100 AS probability FROM split WHERE split = 'test'
  UNION ALL SELECT 'decision_tree', churn_flag, 1.0::DOUBLE - tenure / 100.0::DOUBLE FROM split WHERE split = 'test'),
judged AS MATERIALIZED (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores),
matrix AS (SELECT model, {_CONFUSION} FROM judged GROUP BY model),
ties AS (SELECT model, probability, count(*) FILTER (churn_flag = 1) AS pos, count(*) FILTER (churn_flag = 0) AS neg
  FROM judged GROUP BY ALL),
ranks AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY probability
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ties),
areas AS (SELECT model, {rnd("(sum(pos * (below * 2 + neg))::DOUBLE / (sum(pos)::DOUBLE * sum(neg) * 2.0::DOUBLE))", 4)}
  AS roc_auc FROM ranks GROUP BY model),
evaluated AS (SELECT matrix.*, {_METRICS}, roc_auc FROM matrix JOIN areas USING (model))"""


def _unit(x: str, digits: int) -> str:
    return f"CAST(round(({x}) * {10**digits}.0::DOUBLE) AS HUGEINT)"


def _zscore(x: str, digits: int, source: str) -> str:
    """Column over a statistics subquery named st_<x>."""
    return rnd(f"(({x}::DOUBLE - st.{x}_m) / st.{x}_d)", 6)


def _stats(columns: dict, source: str) -> str:
    parts = []
    for x, digits in columns.items():
        unit = _unit(x, digits)
        parts.append(f"sum({unit})::DOUBLE / count(*) / {10**digits}.0::DOUBLE AS {x}_m")
        parts.append(f"sqrt((count(*)::HUGEINT * sum({unit} * {unit})::HUGEINT - sum({unit})::HUGEINT * "
                     f"sum({unit})::HUGEINT)::DOUBLE) / count(*) / {10**digits}.0::DOUBLE AS {x}_d")
    return f"SELECT {', '.join(parts)} FROM {source}"


# Equal profiles are counted first; items of a profile stand for that many rows.
_ITEMS = f"""{STAGED_CUSTOMER_SQL},
profile AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (
  SELECT {", ".join(PLAN_COLUMNS)}, CASE WHEN churn_flag = 1 THEN 'Yes' ELSE 'No' END AS Churn, count(*) AS w
  FROM staged GROUP BY ALL)),
items AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT id, w, '{c}=' || {c} AS item FROM profile" for c in (*PLAN_COLUMNS, "Churn"))})"""


def _sets(items_cte: str, support: float) -> str:
    """Frequent sets of one to three items by self joins of the profiles' frequent items."""
    return f"""{items_cte},
total AS MATERIALIZED (SELECT sum(w)::DOUBLE AS n FROM profile),
one AS MATERIALIZED (SELECT item AS a, sum(w) AS c FROM items, total GROUP BY item, n HAVING sum(w) / n >= {support}),
kept AS MATERIALIZED (SELECT id, w, item FROM items JOIN one ON item = a),
two AS MATERIALIZED (SELECT x.item AS a, y.item AS b, sum(x.w) AS c FROM kept x JOIN kept y
  ON x.id = y.id AND x.item < y.item GROUP BY ALL),
three AS MATERIALIZED (SELECT x.item AS a, y.item AS b, z.item AS d, sum(x.w) AS c FROM kept x JOIN kept y
  ON x.id = y.id AND x.item < y.item JOIN kept z ON x.id = z.id AND y.item < z.item GROUP BY ALL),
sets AS (SELECT [a] AS s, c FROM one UNION ALL SELECT [a, b], c FROM two
  UNION ALL SELECT [a, b, d], c FROM three),
frequent AS MATERIALIZED (SELECT s, CAST(c AS BIGINT) AS c, c / n AS support FROM sets, total WHERE c / n >= {support})"""


def _rules(items_cte: str, support: float, confidence: float, lift: float, target: str | None) -> str:
    only = f"WHERE consequent = '{target}'" if target else ""
    return f"""{_sets(items_cte, support)},
sided AS (SELECT s, support, unnest(s) AS consequent FROM frequent WHERE len(s) > 1),
wanted AS (SELECT *, list_filter(s, lambda x: x <> consequent) AS lhs FROM sided {only}),
joined AS (SELECT w.*, l.support AS ls, r.support AS rs, w.support / l.support AS conf,
    w.support / l.support / r.support AS lft
  FROM wanted w JOIN frequent l ON w.lhs = l.s JOIN frequent r ON r.s = [w.consequent]),
rules AS (SELECT array_to_string(lhs, ' & ') AS antecedent, consequent, {rnd("support", 4)} AS support,
    {rnd("conf", 4)} AS confidence, {rnd("lft", 4)} AS lift, {rnd("ls", 4)} AS antecedent_support,
    {rnd("rs", 4)} AS consequent_support
  FROM joined WHERE conf >= {confidence} AND lft >= {lift})"""


_CHURN_RULES = _rules(_ITEMS, target=rules.TARGET, support=RULE_LIMITS["min_support"],
                      confidence=RULE_LIMITS["min_confidence"], lift=RULE_LIMITS["min_lift"])
_LINE_NAMES = ("o_orderpriority", "o_orderstatus", "p_type", "l_linestatus", "l_returnflag")
_LINE_ITEMS = f"""profile AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (
  SELECT {", ".join(_LINE_NAMES)}, count(*) AS w FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)),
items AS MATERIALIZED ({" UNION ALL ".join(f"SELECT id, w, '{c}=' || {c} AS item FROM profile" for c in _LINE_NAMES)})"""


def _one_hot() -> str:
    return " UNION ALL ".join(
        f"""SELECT split, '{c}_' || v AS feature, count(*) FILTER (x = v) AS ones FROM (
  SELECT split, CAST({c} AS VARCHAR) AS x FROM split) JOIN (SELECT v FROM (SELECT v, row_number() OVER
    (ORDER BY v) AS r FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM split WHERE split = 'train'))
    WHERE r > 1) ON TRUE GROUP BY ALL""" for c in churn.CATEGORICAL)


SQL = {
    "e1_modelling_table": f"WITH {_MODEL} SELECT * FROM model",
    "e2_feature_nulls": f"WITH {_MODEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM model"
        for c in ("tenure", "monthly_charges", "total_charges", *churn.CATEGORICAL)),
    "e3_stratified_split": f"WITH {_SPLIT} SELECT customerID, churn_flag, split FROM split",
    "e3_hashed_split": f"WITH {_MODEL} SELECT customerID, CASE WHEN CAST('0x' || substr(md5(customerID || '42'), 1, 12) "
                       "AS BIGINT) / 281474976710656.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split FROM model",
    "e4_class_distribution": f"WITH {_SPLIT}, counts AS (SELECT split, churn_flag, count(*) AS row_count "
                             "FROM split GROUP BY ALL), shares AS (SELECT *, row_count / sum(row_count) OVER "
                             "(PARTITION BY split) * 100.0::DOUBLE AS share FROM counts) "
                             f"SELECT split, churn_flag, row_count, {rnd('share', 2)} AS share_pct FROM shares",
    "e5_scaled_numerics": f"WITH {_SPLIT}, st AS ({_stats(MONEY, 'split WHERE split = ' + repr('train'))}) "
                          f"SELECT customerID, split, {', '.join(_zscore(c, p, 'split') + f' AS {c}' for c, p in MONEY.items())} "
                          "FROM split, st",
    "e6_encoded_categories": f"WITH {_SPLIT} {_one_hot()}",
    "e7_class_weights": f"WITH {_MODEL} SELECT churn_flag, count(*) AS row_count, "
                        + rnd("(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE)", 6)
                        + " AS weight FROM model GROUP BY churn_flag",
    "e11_confusion": f"WITH {_PRED} SELECT {_CONFUSION} FROM pred",
    "e12_metrics": f"WITH {_PRED}, m AS (SELECT {_CONFUSION} FROM pred) SELECT *, {_METRICS} FROM m",
    "e14_feature_ranks": f"""WITH f AS (SELECT o_orderpriority AS feature,
  {rnd("(count(*) FILTER (o_orderstatus = 'F') / count(*))", 2)} AS dt_importance,
  {rnd("((count(*) FILTER (o_orderstatus = 'P') - count(*) FILTER (o_orderstatus = 'O')) / 100.0::DOUBLE)", 2)}
    AS lr_coefficient FROM orders GROUP BY 1)
SELECT *, abs(lr_coefficient) AS lr_abs_coef,
  CASE WHEN lr_coefficient > 0.05 THEN 'Associated with higher predicted churn probability'
    WHEN lr_coefficient < -0.05 THEN 'Associated with lower predicted churn probability (retention)'
    ELSE 'Negligible direct directional effect' END AS association_direction,
  CAST(rank() OVER (ORDER BY dt_importance DESC) AS INTEGER) AS relative_dt_rank,
  CAST(rank() OVER (ORDER BY abs(lr_coefficient) DESC) AS INTEGER) AS relative_lr_rank FROM f""",
    "f1_kpi_table": f"WITH {OBS} SELECT cell_id, region, technology, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, "
                    f"{', '.join(KPIS)} FROM obs",
    "f2_standardised_kpis": f"WITH {OBS}, st AS ({_stats(LINE_DIGITS, 'lines')}) SELECT cell_id, "
                            + ", ".join(f"{_zscore(k, p, 'obs')} AS {k}" for k, p in LINE_DIGITS.items())
                            + " FROM obs, st",
    "f4_inertia": f"WITH {LINES}, c AS (SELECT {LABEL_SQL} AS cluster_id, "
                  + ", ".join(f"sum({k}::DOUBLE * {k}::DOUBLE) - sum({k}::DOUBLE) * sum({k}::DOUBLE) / count(*) AS {k}_v"
                              for k in KPIS)
                  + " FROM lines GROUP BY 1) SELECT " + rnd(f"sum({' + '.join(k + '_v' for k in KPIS)})", 2)
                  + " AS inertia FROM c",
    "f7_cluster_profiles": f"""WITH {LINES}, p AS (SELECT {LABEL_SQL} AS cluster_id, count(*) AS observation_count,
  {", ".join(f"{avg(k, LINE_DIGITS[k], empty=None)} AS {k}" for k in KPIS)} FROM lines GROUP BY 1)
SELECT *, {rnd("(observation_count / sum(observation_count) OVER () * 100.0::DOUBLE)", 2)} AS network_share_pct,
  CASE WHEN call_drop_rate_pct > 5 OR latency_ms > 100
      THEN 'Severe Degradation (Critical Congestion / High Drop Rate)'
    WHEN signal_strength_dbm < -85 THEN 'Weak Signal / Cell Edge (Coverage Gap)'
    WHEN throughput_mbps > 400 THEN 'Optimal High-Performance 5G Core'
    ELSE 'Healthy Baseline Operation (Normal QoS)' END AS operational_interpretation FROM p""",
    "f9_transactions": f"WITH {STAGED_CUSTOMER_SQL}, items AS (" + " UNION ALL ".join(
        f"SELECT customerID, '{c}=' || {x} AS item FROM staged" for c, x in (
            *((c, c) for c in PLAN_COLUMNS), ("Churn", "CASE WHEN churn_flag = 1 THEN 'Yes' ELSE 'No' END")))
        + ") SELECT customerID, string_agg(item, ' & ' ORDER BY item) AS items FROM items GROUP BY customerID",
    "f10_frequent_itemsets": f"WITH {_sets(_ITEMS, 0.05)} SELECT array_to_string(s, ' & ') AS itemset, "
                             "CAST(len(s) AS INTEGER) AS items, c AS row_count, support FROM frequent",
    "f11_association_rules": f"WITH {_CHURN_RULES} SELECT * FROM rules",
    "f11_rules_any_consequent": f"WITH {_rules(_LINE_ITEMS, 0.01, 0.3, 1.0, None)} SELECT * FROM rules",
    "f13_rule_query": f"WITH {_CHURN_RULES} SELECT * FROM rules WHERE confidence >= 0.5 "
                      "ORDER BY lift DESC, confidence DESC, antecedent LIMIT 500",
    "f13_rule_totals": f"WITH {_CHURN_RULES} SELECT count(*) AS total_rules_available, "
                       "least(count(*) FILTER (confidence >= 0.5), 500) AS filtered_rules_count FROM rules",
    "f15_rule_search": f"WITH {_CHURN_RULES} SELECT * FROM rules WHERE lower(antecedent) LIKE '%fiber%'",
    "f16_rule_strength": f"WITH {_CHURN_RULES} SELECT *, CASE WHEN lift > 2 THEN 'High Affinity' WHEN lift > 1.3 "
                         "THEN 'Moderate Affinity' ELSE 'Baseline' END AS strength FROM rules",
}
SQL["f3_lloyd_pass"] = f"""WITH {LINES}, st AS ({_stats(LINE_DIGITS, 'lines')}),
z AS MATERIALIZED (SELECT row_number() OVER () AS id, {", ".join(f"({x}::DOUBLE - st.{x}_m) / st.{x}_d AS {x}" for x in KPIS)} FROM lines, st),
c AS (SELECT k, unnest(range(k)) AS j FROM (VALUES (2), (3), (4), (5)) t(k)),
spots AS (SELECT k, CAST(j AS INTEGER) AS j, {-PASS_EDGE}::DOUBLE + {2 * PASS_EDGE}::DOUBLE * j / (k - 1) AS p FROM c),
away AS (SELECT id, k, j, {" + ".join(f"({x} - p) * ({x} - p)" for x in KPIS)} AS away FROM z, spots),
near AS (SELECT id, k, arg_min(j, away) AS cluster_id, min(away) AS away FROM away GROUP BY id, k),
cost AS (SELECT k, sum(away) AS inertia FROM near GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, cluster_id, count(*) AS row_count, {rnd("any_value(inertia)", 2)} AS inertia,
  {", ".join(f"{rnd(f'avg({x})', 4)} AS {x}" for x in KPIS)}
FROM near JOIN z USING (id) JOIN cost USING (k) GROUP BY k, cluster_id"""
# The mean squared distance of a row to a cluster follows from the cluster's sums.
SQL["f5_fixed_silhouette"] = f"""WITH {LINES}, st AS ({_stats(LINE_DIGITS, 'lines')}),
z AS MATERIALIZED (SELECT row_number() OVER () AS id, {LABEL_SQL} AS c,
  {", ".join(f"({x}::DOUBLE - st.{x}_m) / st.{x}_d AS z_{x}" for x in KPIS)} FROM lines, st),
w AS MATERIALIZED (SELECT *, {" + ".join(f"z_{x} * z_{x}" for x in KPIS)} AS w FROM z),
m AS MATERIALIZED (SELECT c AS o, count(*) AS n, avg(w) AS q, {", ".join(f"avg(z_{x}) AS m_{x}" for x in KPIS)} FROM w GROUP BY c),
d AS (SELECT id, c, o, n, w + q - 2 * ({" + ".join(f"z_{x} * m_{x}" for x in KPIS)}) AS away FROM w, m),
s AS (SELECT id, any_value(n) FILTER (c = o) AS n, min(away) FILTER (c = o) AS own, min(away) FILTER (c <> o) AS b
  FROM d GROUP BY id),
v AS (SELECT n, own * n / nullif(n - 1, 0) AS a, b FROM s)
SELECT {rnd("avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)", 4)} AS silhouette_score FROM v"""
SQL["f5_site_silhouette"] = f"""WITH site AS MATERIALIZED (SELECT l_suppkey AS id, any_value(n_regionkey) AS c,
  avg(l_quantity::DOUBLE * 4) AS x, avg(l_extendedprice::DOUBLE / 1000) AS y, avg(l_discount::DOUBLE * 100) AS z
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_suppkey),
sizes AS (SELECT c AS o, count(*) AS n FROM site GROUP BY c),
away AS (SELECT i.id, i.c, j.c AS o, sum(sqrt((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)
  + (i.z - j.z) * (i.z - j.z))) AS t FROM site i, site j GROUP BY ALL),
v AS (SELECT id, max(n) FILTER (c = o) AS n, max(t / nullif(n - 1, 0)) FILTER (c = o) AS a,
  min(t / n) FILTER (c <> o) AS b FROM away JOIN sizes USING (o) GROUP BY id)
SELECT {rnd("avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)", 4)} AS silhouette_score,
  0.0::DOUBLE AS standard_error, 0.0::DOUBLE AS bound_99, count(*) AS sampled_rows, count(*) AS row_count FROM v"""
SQL["e10_given_evaluation"] = f"WITH {_GIVEN} SELECT * FROM evaluated"
SQL["f14_fixed_overview"] = f"""WITH e AS (WITH {_GIVEN} SELECT * FROM evaluated),
r AS (WITH {_CHURN_RULES} SELECT count(*) AS n FROM rules)
SELECT string_agg(model, ', ' ORDER BY model) AS models_trained,
  max(roc_auc) FILTER (model = 'logistic_regression') AS logistic_regression_roc_auc,
  max(roc_auc) FILTER (model = 'decision_tree') AS decision_tree_roc_auc, '2, 3, 4, 5' AS k_values_evaluated,
  3 AS selected_k, (SELECT n FROM r) AS total_rules_mined FROM e"""
SQL["f6_fixed_assignment"] = f"""WITH {LINES}, st AS ({_stats(LINE_DIGITS, 'lines')}),
z AS MATERIALIZED (SELECT row_number() OVER () AS id, technology,
  {", ".join(f"({x}::DOUBLE - st.{x}_m) / st.{x}_d AS z_{x}" for x in KPIS)} FROM lines, st),
spots AS (SELECT CAST(j AS INTEGER) AS j, {-PASS_EDGE}::DOUBLE + {2 * PASS_EDGE}::DOUBLE * j / 3 AS p FROM range(4) t(j)),
away AS (SELECT id, technology, j, {" + ".join(f"(z_{x} - p) * (z_{x} - p)" for x in KPIS)} AS away FROM z, spots),
near AS (SELECT id, technology, arg_min(j, away) AS cluster_id FROM away GROUP BY id, technology)
SELECT technology, cluster_id, count(*) AS row_count FROM near GROUP BY ALL"""
SQL["f7_stored_profiles"] = SQL["f7_cluster_profiles"]
_AUC = f"""WITH {_PRED}, g AS (SELECT probability, count(*) FILTER (churn_flag = 1) AS pos,
  count(*) FILTER (churn_flag = 0) AS neg FROM pred GROUP BY 1),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS below FROM g)
SELECT {rnd("(sum(pos * (below * 2 + neg))::DOUBLE / (sum(pos)::DOUBLE * sum(neg) * 2.0::DOUBLE))", 4)} AS roc_auc FROM r"""
SQL["e13_roc_auc"] = SQL["e13_roc_auc_by_parts"] = _AUC
