"""Rules, classification and clustering: invariants, ranges and brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from driver import mining_queries, raw
from driver.tables import LINE_DIGITS, line_kpis
from starcell.operators import churn, clusters, features, rules

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return mining_queries.modelling(spark, SF_DIR)


@pytest.fixture(scope="module")
def models(spark):
    return mining_queries.trained(spark, SF_DIR)


# Rules

def profiles(spark):
    rows = [("a", "x", "p", 3), ("a", "y", "p", 2), ("b", "x", "q", 4), ("b", "y", None, 1), ("a", "x", "q", 2)]
    return spark.createDataFrame(rows, "u string, v string, w string, n int")


def test_itemsets_by_brute_force(spark):
    df = profiles(spark)
    counted = rules.baskets(df, {c: F.col(c) for c in "uvw"}, F.col("n"))
    found = {tuple(r.itemset): r.row_count for r in rules.frequent_itemsets(counted, 0.2).collect()}
    want = {}
    for row in df.collect():
        items = sorted(f"{c}={row[c]}" for c in "uvw" if row[c] is not None)
        for size in (1, 2, 3):
            for chosen in combinations(items, size):
                want[chosen] = want.get(chosen, 0) + row.n
    assert found == {k: n for k, n in want.items() if n / 12 >= 0.2}


def test_longer_itemsets_and_odd_baskets(spark):
    """Up to five items; unsorted, repeated, empty and missing items."""
    given = [(["d", "b", "a", "c", "e"], 3), (["a", "b", "c", "d"], 2), (["a", "a", "b"], 4), ([], 1), (None, 1),
             (["e", "c", "a"], 2), (["a", "b"], 1), (["a", "b"], 1)]
    counted = spark.createDataFrame(given, "items array<string>, weight int")
    for most in (1, 2, 5):
        found = {tuple(r.itemset): r.row_count for r in rules.frequent_itemsets(counted, 0.2, most).collect()}
        want = {}
        for items, n in given:
            for size in range(1, most + 1):
                for chosen in combinations(sorted(set(items or [])), size):
                    want[chosen] = want.get(chosen, 0) + n
        assert found == {k: n for k, n in want.items() if n / 15 >= 0.2}


def test_itemsets_are_those_of_fpgrowth(spark):
    house = raw.warehouse(spark, SF_DIR)
    counted = rules.churn_baskets(house.read("fact_customer_churn"), house.read("dim_plan"))
    found = rules.frequent_itemsets(counted, 0.1).select(
        F.array_join("itemset", "&").alias("s"), "row_count")
    expanded = counted.select("items", F.explode(F.sequence(F.lit(1), F.col("weight"))))
    model = FPGrowth(itemsCol="items", minSupport=0.1).fit(expanded.select("items"))
    want = model.freqItemsets.where(F.size("items") <= 3).select(
        F.array_join(F.array_sort("items"), "&").alias("s"), F.col("freq").alias("row_count"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_rules_hold_their_limits(spark):
    found = mining_queries.stored_rules(spark, SF_DIR).collect()
    assert found
    for r in found:
        assert r.consequent == "Churn=Yes" and r.confidence >= 0.35 and r.lift >= 1.2
        assert r.support >= 0.05 and r.antecedent.count(" & ") <= 1
        assert r.confidence == pytest.approx(r.support / r.antecedent_support, abs=0.002)
    assert len({r.antecedent for r in found}) == len(found)


def test_no_rules(spark):
    counted = rules.baskets(profiles(spark), {"u": F.col("u")})
    sets = rules.frequent_itemsets(counted, 0.9)
    assert rules.association_rules(sets).count() == 0
    empty = rules.baskets(profiles(spark).where("false"), {"u": F.col("u")})
    assert rules.frequent_itemsets(empty, 0.5).count() == 0


def test_rule_arguments(spark):
    found = mining_queries.stored_rules(spark, SF_DIR)
    with pytest.raises(ValueError):
        rules.query_rules(found, limit=0)
    assert rules.query_rules(found, min_confidence=0.0).count() == found.count()
    with pytest.raises(ValueError):
        rules.query_rules(found, min_confidence=1.5)
    top = rules.query_rules(found, min_confidence=0.0, limit=3).collect()
    lifts = [r.lift for r in found.collect()]
    assert [r.lift for r in top] == sorted(lifts, reverse=True)[:3]


# Classification

def test_leak_guard():
    assert churn.feature_columns(["customerID", "tenure", "churn_flag"]) == ["tenure"]
    with pytest.raises(ValueError, match="leak"):
        churn.require_no_leak(["tenure", "customerID"])
    with pytest.raises(ValueError, match="missing"):
        churn.feature_columns(["tenure"])


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact_and_complete(spark, table, digits):
    split = churn.stratified_split(table, "churn_flag", "customerID", bucket_digits=digits)
    counts = {(r.split, r.churn_flag): r["count"] for r in split.groupBy("split", "churn_flag").count().collect()}
    rows = table.count()
    assert sum(counts.values()) == rows == split.select("customerID").distinct().count()
    assert counts["test", 0] + counts["test", 1] == -(-rows // 5)
    for flag in (0, 1):
        whole = counts["test", flag] + counts["train", flag]
        assert abs(counts["test", flag] - whole / 5) <= 1
    again = churn.stratified_split(table.repartition(5), "churn_flag", "customerID", bucket_digits=4)
    assert split.select("customerID", "split").exceptAll(again.select("customerID", "split")).count() == 0


def test_hashed_split_is_near(table):
    share = churn.hashed_split(table, "customerID").agg(F.avg((F.col("split") == "test").cast("int"))).first()[0]
    assert 0.15 < share < 0.25


def test_scaling_of_training_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    for digits in (2, None):
        scaling = features.Scaling.fit(df, {"x": digits, "c": digits})
        mean, deviation = scaling.stats["x"]
        assert mean == pytest.approx(7 / 3) and deviation == pytest.approx(np.std([1, 2, 4]))
        assert [r.c for r in scaling.apply(df).collect()] == [0.0] * 3


def dense(encoder, rows):
    return [tuple(r.features.toArray()) for r in encoder.apply(rows).collect()]


def feature_names(encoder):
    return [r.feature for r in encoder.names().orderBy("place").collect()]


@pytest.mark.parametrize("inline", [100, 0])
def test_unknown_level_is_all_zero(spark, monkeypatch, inline):
    """Looked up in the row or joined: the same vectors."""
    monkeypatch.setattr(features, "INLINE_LEVELS", inline)
    train = spark.createDataFrame([("b", 1, 7, None), ("a", 2, 7, None), ("c", 10, 7, None)],
                                  "g string, h int, one int, none string")
    encoder = features.Preprocessor.fit(train, {"h": 0}, ["g", "one", "h", "none"])
    assert feature_names(encoder) == ["h", "g_b", "g_c", "h_10", "h_2"]  # as texts
    other = spark.createDataFrame([("a", 10, 7, "x"), ("c", 2, 8, None), ("z", 3, None, None), (None, 1, 7, "y")],
                                  train.schema).coalesce(1)
    assert [v[1:] for v in dense(encoder, other)] == [(0, 0, 1, 0), (0, 1, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    again = features.Preprocessor.from_rows(encoder.as_rows(spark))
    assert feature_names(again) == feature_names(encoder) and dense(again, other) == dense(encoder, other)


def test_no_rows_or_levels(spark):
    nothing = spark.createDataFrame([], "g string, x double")
    assert features.OneHot.fit(nothing, ["g"]).width() == 0
    train = spark.createDataFrame([(None, 1.0), (None, 3.0)], "g string, x double")
    encoder = features.Preprocessor.fit(train, {"x": 0}, ["g"])
    assert dense(encoder, train.coalesce(1)) == [(-1.0,), (1.0,)]
    only = features.Preprocessor.fit(spark.createDataFrame([("a",), ("b",)], "g string"), {}, ["g"])
    assert feature_names(only) == ["g_b"]


def test_many_levels_train(spark):
    """A category of 100,000 levels is no special case: it is joined, and its vectors are sparse."""
    levels = 100_000
    rows = spark.range(0, 2 * levels, 1, 8).select(
        F.concat(F.lit("v"), F.col("id") % levels).alias("g"), (F.col("id") % 10).cast("double").alias("x"),
        (F.col("id") % levels < levels // 2).cast("int").alias("y"), F.lit(1.0).alias("weight"))
    encoder = features.Preprocessor.fit(rows, {"x": 0}, ["g"])
    assert encoder.width() == levels
    ready = encoder.apply(rows, ["y", "weight"])
    assert all(len(r.features.indices) <= 2 for r in ready.limit(100).collect())
    model = churn.fit_logistic(ready, "y", max_iter=3)
    table = churn.named_features(encoder.names(), [0.0] * levels, model.coefficients.toArray())
    picked = {r.feature: r.lr_coefficient for r in table.where("feature IN ('g_v1', 'g_v99999')").collect()}
    assert picked["g_v1"] > 0 > picked["g_v99999"]


def test_model_quality(models):
    rows = {r.model: r for r in models.evaluation().collect()}
    for row in rows.values():
        assert row.true_negative + row.false_positive + row.false_negative + row.true_positive > 0
        assert 0.6 <= row.accuracy <= 1 and row.recall > 0.5 and 0.7 <= row.roc_auc <= 1


def test_logistic_is_the_ridge_solution(spark, models):
    """Newton's method on the weighted, penalised likelihood gives the same coefficients."""
    rows = models.train.toPandas()
    x = np.vstack([v.toArray() for v in rows["features"]])
    x = np.hstack([x, np.ones((len(x), 1))])
    y, w = rows["churn_flag"].to_numpy(float), rows["weight"].to_numpy()
    beta, penalty = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + penalty @ beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + penalty
        beta -= np.linalg.solve(hessian, gradient)
    got = np.append(models.logistic.coefficients.toArray(), models.logistic.intercept)
    assert np.abs(got - beta).max() < 1e-3


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(y), round(float(s), 1)) for y, s in zip(rng.integers(0, 2, 200), rng.random(200))]
    df = spark.createDataFrame(rows, "churn_flag int, probability double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for parts in (1, 7):
        assert churn.roc_auc(df.repartition(parts)).first().roc_auc == pytest.approx(want, abs=5e-5)
    assert churn.roc_auc(df.where("churn_flag = 1")).first().roc_auc is None


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "churn_flag int, prediction int")
    row = churn.classification_metrics(churn.confusion(df)).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_feature_ranks_share_ties(spark):
    rows = churn.feature_table(spark, ["a", "b", "c"], [0.5, 0.5, 0.1], [0.05, -0.2, 0.06]).collect()
    assert [(r.feature, r.relative_dt_rank) for r in rows] == [("b", 1), ("a", 1), ("c", 3)]
    text = {r.feature: r.association_direction for r in rows}
    assert text["a"].startswith("Negligible") and "lower" in text["b"] and "higher" in text["c"]


def test_saved_models_score_the_same(spark, models, table, tmp_path):
    models.save(spark, str(tmp_path))
    preprocessor, logistic, _ = churn.load_models(spark, str(tmp_path))
    assert feature_names(preprocessor) == feature_names(models.preprocessor)
    fresh = churn.score(logistic, preprocessor.apply(table, ["churn_flag"]))
    kept = churn.score(models.logistic, models.preprocessor.apply(table, ["churn_flag"]))
    assert fresh.exceptAll(kept).count() == 0


def test_weights_of_many_classes(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("c")).unionAll(spark.range(1).select(F.lit(7).alias("c")))
    weights = {r.c: r.weight for r in churn.balanced_weights(df, "c").collect()}
    assert len(weights) == 1500 and weights[7] == pytest.approx(3001 / 1500 / 3)
    rows = churn.with_weights(df, churn.balanced_weights(df, "c"), "c")
    assert rows.count() == 3001 and rows.agg(F.sum("weight")).first()[0] == pytest.approx(3001)


def test_small_and_large_values_are_not_cut(spark):
    for unit in (1e-7, 1e14):
        df = spark.createDataFrame([(unit * i,) for i in range(1, 10)], "x double")
        mean, deviation = features.Scaling.fit(df, {"x": None}).stats["x"]
        assert mean == pytest.approx(5 * unit) and deviation == pytest.approx(np.std(np.arange(1, 10)) * unit)
        assert clusters.EXACT_DIGITS is None


# Clustering

@pytest.fixture(scope="module")
def points(spark):
    return mining_queries.kmeans_inputs(spark, SF_DIR)


def test_scaled_features(spark, points):
    rows = np.vstack([r.features.toArray() for r in points.select("features").collect()])
    assert np.abs(rows.mean(0)).max() < 1e-9 and np.abs(rows.std(0) - 1).max() < 1e-9


def test_null_kpis_fail(spark):
    broken = line_kpis(spark, SF_DIR).withColumn("latency_ms", F.nullif("latency_ms", F.lit(40.0)))
    with pytest.raises(ValueError, match="latency_ms"):
        clusters.scaled_features(broken, LINE_DIGITS)


def test_sweep_improves_with_k(spark, points):
    rows = clusters.k_sweep(points, (2, 3, 4), restarts=2).collect()
    costs = [r.inertia for r in rows]
    assert costs == sorted(costs, reverse=True)
    assert all(-1 <= r.silhouette_score <= 1 for r in rows)


def test_sweep_is_as_good_as_separate_fits(spark, points):
    row = clusters.k_sweep(points, (4,), restarts=5).first()
    model = clusters.best_model(points, 4, restarts=5)
    assert row.inertia <= model.summary.trainingCost * 1.001


def test_inertia_is_the_training_cost(spark, points):
    model = clusters.best_model(points, 3, restarts=1)
    scaled = model.transform(points)
    from pyspark.ml.functions import vector_to_array
    names = {f"z{i}": vector_to_array("features")[i] for i in range(7)}
    got = clusters.inertia(scaled, names, "prediction").first().inertia
    assert got == pytest.approx(model.summary.trainingCost, rel=1e-3)


def test_stored_results_are_read_back(spark, tmp_path):
    from starcell.operators import results
    kept = results.Results(spark, str(tmp_path))
    assigned = results.store_clusters(kept, line_kpis(spark, SF_DIR), LINE_DIGITS, (2, 3), restarts=2)
    assert {r.cluster_id for r in kept.read("cluster_profiles").collect()} == {0, 1, 2}
    assert [r.k for r in kept.read("clustering_metrics").orderBy("k").collect()] == [2, 3]
    scaling, model = results.load_clusters(kept)
    assert model.getK() == 3 and set(scaling.stats) == set(clusters.KPIS)
    assert assigned.count() == line_kpis(spark, SF_DIR).count()


def test_profile_labels(spark):
    base = dict(call_drop_rate_pct=1.0, latency_ms=20.0, signal_strength_dbm=-60.0, throughput_mbps=100.0)
    cases = [({"call_drop_rate_pct": 5.1}, 0), ({"latency_ms": 100.1, "signal_strength_dbm": -90.0}, 0),
             ({"signal_strength_dbm": -85.1}, 1), ({"throughput_mbps": 400.1}, 2), ({}, 3)]
    for change, place in cases:
        df = spark.createDataFrame([tuple({**base, **change}.values())], ", ".join(f"{k} double" for k in base))
        assert df.select(clusters.profile_label().alias("l")).first().l == clusters.PROFILE_LABELS[place]
