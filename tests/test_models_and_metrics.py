"""Metrics, splits, models and permutation importance."""

import random
from datetime import date, timedelta
from statistics import median

import pytest
from fixtures import SCOPE, rows_of
from pyspark.sql import functions as F
from test_features import busy_sources

from shelfspark.fixed_values import NUMERIC_FEATURES
from shelfspark.operators import metrics, modeling
from shelfspark.operators.contracts import forbid_features
from shelfspark.operators.quality import prediction_audit
from shelfspark.operators.ranking import ranking_metrics, score_histogram, threshold_metrics
from shelfspark.operators.splits import holdout_start
from shelfspark.plans.decisions import ModelStages


def brute_force(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    precision = 0.0
    for p in pos:
        taken = [y for s, y in pairs if s >= p]
        precision += sum(taken) / len(taken)
    return auc, precision / len(pos)


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_areas_against_brute_force(spark, digits):
    rng = random.Random(digits)
    pairs = [(round(rng.random() ** 3, digits), int(rng.random() < 0.3)) for _ in range(300)]
    pairs += [(0.0, 0), (1.0, 1), (1.0, 0)]
    df = spark.createDataFrame([("m", *pair) for pair in pairs], "g string, s double, y int")
    row = ranking_metrics(df, "y", "s", ["g"]).first()
    assert (row.roc_auc, row.pr_auc) == pytest.approx(brute_force(pairs))


def test_areas_with_scores_closer_than_a_bucket(spark):
    pairs = [(0.5 + i * 1e-12, i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(s, int(y)) for s, y in pairs], "s double, y int")
    row = ranking_metrics(df, "y", "s").first()
    assert (row.roc_auc, row.pr_auc) == pytest.approx(brute_force(pairs))


def test_published_rule_baseline(spark):
    """A 0/1 score with the published confusion counts gives the published areas."""
    counts = [(1, 1, 68), (1, 0, 174), (0, 1, 70), (0, 0, 2568)]
    df = spark.createDataFrame(counts, "s int, y int, n int").select(
        "s", "y", F.explode(F.sequence(F.lit(1), F.col("n"))))
    row = ranking_metrics(df, "y", "s").first()
    assert row.pr_auc == pytest.approx(0.1627652513275)
    assert row.roc_auc == pytest.approx(0.7146481463863)
    rates = metrics.classification_rates(metrics.confusion_counts(
        df.withColumn("predicted", F.col("s")), "y", "predicted")).first()
    assert (rates.precision, rates.recall, rates.f1) == pytest.approx(
        (0.2809917355, 0.4927536232, 0.3578947368))


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    row = ranking_metrics(df, "y", "s").first()
    assert row.roc_auc is None and row.pr_auc is None
    rates = metrics.classification_rates(metrics.confusion_counts(
        df.withColumn("p", F.lit(0)), "y", "p")).first()
    assert (rates.precision, rates.recall, rates.f1) == (0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 1.0), (10.0, 6.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert (row.mae, row.wape, row.bias, row.forecast_accuracy) == pytest.approx(
        (7 / 3, 0.35, -0.05, 0.65))
    none = metrics.regression_metrics(df.filter("y = 0"), "y", "p").first()
    assert none.wape is None and none.bias is None and none.mae == 1.0


def test_holdout_needs_nine_weeks(spark):
    weeks = [(date(2025, 1, 6) + timedelta(7 * i),) for i in range(9)]
    df = spark.createDataFrame(weeks, "week_start_date date")
    assert holdout_start(df) == date(2025, 1, 13)
    with pytest.raises(ValueError):
        holdout_start(df.filter("week_start_date > '2025-01-06'"))


def test_labels_are_no_features():
    with pytest.raises(ValueError):
        forbid_features([*NUMERIC_FEATURES, "demand_pred"])


def test_dense_positions_are_a_permutation(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = modeling.dense_positions(df, ["k"], 1, "n", buckets=16)
    b = modeling.dense_positions(df, ["k"], 2, "n", buckets=16)
    assert rows_of(a, "n") == rows_of(b, "n") == sorted(
        [(i,) for i in range(500)], key=lambda r: (False, str(r[0])))
    assert rows_of(a, "k", "n") != rows_of(b, "k", "n")


@pytest.fixture(scope="module")
def stages(spark):
    from shelfspark.plans.features import feature_table
    from shelfspark.session import staged

    return ModelStages(staged(feature_table(busy_sources(spark), SCOPE), "features"), rounds=5,
                       depth=3)


def test_models_end_to_end(stages):
    demand = stages.demand_predictions()
    assert demand.count() == 8 * 4 and demand.filter("demand_pred < 0").isEmpty()
    risk = stages.stockout_predictions()
    assert risk.filter("stockout_risk_pred_proba NOT BETWEEN 0 AND 1").isEmpty()
    assert stages.decisions().count() == 7 * 4, "the hold-outs overlap in seven weeks"
    assert stages.kpis().count() == 30
    audit = prediction_audit(demand, risk).collect()
    assert {r.violations for r in audit} == {0} and {r.rows_checked for r in audit} == {8 * 4}
    broken = prediction_audit(demand.withColumn("error", F.lit(None).cast("double")), risk)
    assert broken.filter("violations > 0").first().rule == "demand_error"
    base, model = stages.demand_metrics().orderBy(F.col("model_name").desc()).collect()
    assert model.train_rows == base.train_rows == 4 * 4


def test_exact_medians(spark):
    rows = [(float(i % 7), None if i % 3 else 0.25 * i, None, float("nan")) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, none double, nan double").repartition(5)
    found = modeling.exact_medians(df, df.columns)
    assert found == {"a": median(r[0] for r in rows),
                     "b": median(r[1] for r in rows if r[1] is not None)}


@pytest.fixture(scope="module")
def learnable(spark, stages):
    """20 SKUs and 30 weeks; demand hangs on promotion and SKU, stockouts on available stock."""
    row = stages.stockout.rows.first()
    n = F.col("id")
    planted = {
        "sku_id": F.concat(F.lit("S"), n % 20),
        "week_start_date": F.date_add(F.lit(date(2024, 1, 1)), (F.floor(n / 20) * 7).cast("int")),
        "promo_flag": (n * 13 % 5 < 2).cast("int"),
        "available_qty": n * 31 % 100,
        "inventory_cover_weeks": (n * 17 % 40) / 10,
        "sales_rolling_mean_4w": F.lit(20.0),
        "target_demand_next_1w": 5 + 20 * (n * 13 % 5 < 2).cast("int") + n % 20,
        "target_stockout_risk_next_2w": (n * 31 % 100 < 15).cast("int"),
    }
    return spark.range(600).select(*[
        planted.get(f.name, F.lit(row[f.name])).cast(f.dataType).alias(f.name)
        for f in stages.features.schema])


def test_models_beat_their_baselines_on_learnable_data(learnable):
    fitted = ModelStages(learnable, rounds=8, depth=4)
    wape = {r.model_name: r.wape for r in fitted.demand_metrics().collect()}
    assert wape["GBTRegressor"] < 0.5 * wape["sales_rolling_mean_4w_baseline"]
    areas = {r.model_name: r.pr_auc for r in fitted.stockout_metrics().collect()}
    assert areas["GBTClassifier"] > 0.9 > areas["inventory_cover_stockout_rule_baseline"] + 0.3
    top = modeling.top_features(modeling.stockout_importance(
        fitted.stockout_model, fitted.stockout.rows, fitted.stockout.start, repeats=1), 1)
    assert top.first().feature == "available_qty", "the planted feature comes first"


def test_hashing_is_the_callers_choice(learnable, stages):
    train = modeling._training_rows(learnable, date(2024, 6, 1), "target_demand_next_1w")
    names = [type(s).__name__ for s in modeling.preprocessing(train, hash_width=64)]
    assert "FeatureHasher" in names and "StringIndexer" not in names
    assert "FeatureHasher" not in [type(s).__name__ for s in modeling.preprocessing(train)]


def test_importance_covers_every_feature(stages):
    found = {r.feature: r.importance for r in modeling.demand_importance(
        stages.demand_model, stages.demand.rows, stages.demand.start, repeats=1).collect()}
    assert len(found) == 57
    # Equal up to the order of adding the errors.
    assert found["promo_duration_days"] == pytest.approx(0.0, abs=1e-9), "a constant cannot matter"


@pytest.mark.parametrize("target", ["target_demand_next_1w", "target_stockout_risk_next_2w"])
def test_scores_by_tree_equal_whole_rescoring(learnable, target):
    """Trees left alone keep their output; the copies have the scores that the whole ensemble gives them."""
    fitted = ModelStages(learnable, rounds=6, depth=4)
    model, part = ((fitted.demand_model, fitted.demand) if target.startswith("target_demand")
                   else (fitted.stockout_model, fitted.stockout))
    rows = modeling.model_inputs(part.rows.filter(modeling.is_test(part.start)))
    by_tree = modeling.permuted_scores(model, rows, target, repeats=2)
    whole = model.transform(modeling.shuffled_copies(rows, target, repeats=2))
    score = modeling._positive_probability() if "probability" in whole.columns else F.col("prediction")

    def scores(df):
        found = df.groupBy("repeat", "feature", "label").agg(
            F.sort_array(F.collect_list(F.round("score", 9))).alias("s")).collect()
        return {(r["repeat"], r["feature"], r["label"]): r["s"] for r in found}

    a, b = scores(by_tree), scores(whole.withColumn("score", score))
    assert a.keys() == b.keys() and len({k[1] for k in a}) == 57
    for key, values in a.items():
        assert values == pytest.approx(b[key], abs=1e-8), key


def test_trees_that_split_on_a_feature_are_found(learnable):
    from shelfspark.operators.tree_scores import Ensemble
    fitted = ModelStages(learnable, rounds=6, depth=4)
    model = fitted.stockout_model.stages[-1]
    ensemble = Ensemble.of(model)
    for slot in range(model.numFeatures):
        used = [k for k, t in enumerate(model.trees) if t.featureImportances[slot] > 0]
        assert ensemble.touched([slot]).tolist() == used


def test_confusion_at_thresholds_from_one_histogram(spark):
    """Thresholds on, between, above and below the scores, per group, against plain counts."""
    rng = random.Random(4)
    rows = [(g, round(rng.random(), 1 if g == "a" else 3), int(rng.random() < 0.3)) for g in "ab" for _ in range(200)]
    rows += [("c", 0.25, 1), ("d", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    cuts = {"all": 0.0, "on": 0.4, "between": 0.45, "one": 1.0, "none": 1.5}
    found = {(r.g, r["at"]): (r.true_negative, r.false_positive, r.false_negative, r.true_positive)
             for r in threshold_metrics(score_histogram(df, "y", "s", ["g"]), cuts, ["g"]).collect()}
    assert found == {(g, name): tuple(
        sum(x == g and y == label and (s >= cut) == taken for x, s, y in rows)
        for label, taken in ((0, False), (0, True), (1, False), (1, True)))
        for g in "abcd" for name, cut in cuts.items()}


def test_metrics_scan_the_predictions_once(spark, stages, monkeypatch):
    """The histogram is written by one job; everything else reads it."""
    from shelfspark.operators import ranking
    written = []
    monkeypatch.setattr(ranking, "staged", lambda df, name: written.append(name) or real(df, name))
    real = __import__("shelfspark.session", fromlist=["staged"]).staged
    predictions = stages.stockout_predictions()
    scored = metrics.stockout_metrics(predictions, stages.stockout.metadata)
    assert written == ["score-histogram"]
    files = {f.split("/")[-2] for f in scored.inputFiles()}
    assert not files & {f.split("/")[-2] for f in predictions.inputFiles()}
    assert scored.count() == 3
