import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlucid.config import scratch_dir
from flowlucid.explain.importance import feature_importance
from flowlucid.operators.models import (
    ModelSpec, default_specs, fit_balanced_rf, fit_dt, fit_gnb, fit_hierarchical, fit_lr, fit_rf, hierarchical_report,
    report_predictions, score, train_all, train_missing,
)
from flowlucid.sources import load_model, save_model

FOREST = {"numTrees": 10, "maxDepth": 5}


@pytest.fixture(scope="module")
def learnable(bench):
    """Encoded rows with a label that is a function of the features."""
    rule = (F.col("resp_pkts") > 20) & (F.col("proto") != "icmp")
    labels = bench.features.select("uid", rule.cast("int").alias("target"))
    rows = bench.encoded.join(labels, "uid").cache()
    return rows.filter("not is_test"), rows.filter("is_test")


def quality(model, test, label):
    report = report_predictions(score(model, test, label).withColumn("model", F.lit("m")))
    return {r["class"]: r.f1 for r in report.collect()}


def test_trees_learn_a_rule(learnable):
    train, test = learnable
    for model in (fit_rf(train, "target", numTrees=20, maxDepth=8), fit_dt(train, "target")):
        assert quality(model, test, "target")["macro avg"] > 0.95


def test_forest_keeps_the_nodes_of_rows_and_is_the_same(spark, learnable):
    """Trees are not sent to the tasks of each pass; lists of nodes are checkpointed."""
    train, _ = learnable
    kept, sent = (fit_rf(train, "y", numTrees=5, maxDepth=12, **more) for more in ({}, {"cacheNodeIds": False}))
    assert kept.getOrDefault("cacheNodeIds") and spark.sparkContext.getCheckpointDir()
    assert kept.toDebugString.split("\n", 1)[1] == sent.toDebugString.split("\n", 1)[1]


def test_random_labels_stay_near_the_base_rate(bench):
    assert quality(fit_dt(bench.x_train, "y", maxDepth=2), bench.x_test, "y")["accuracy"] == pytest.approx(0.6, abs=0.1)


def test_logistic_regression_is_at_the_stated_optimum(bench):
    """The gradient of |w|^2 / 2 + C * sum(weight * log loss) vanishes there."""
    model = fit_lr(bench.x_train, "y", C=0.5, tol=1e-10)
    rows = bench.x_train.select(vector_to_array("features").alias("x"), "y").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    weight = len(y) / (2 * np.bincount(y))[y]
    w, b = model.coefficients.toArray(), model.intercept
    gap = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(w + 0.5 * x.T @ gap).max() < 1e-2
    assert abs(gap.sum()) < 1e-2


def test_naive_bayes_statistics(bench):
    model = fit_gnb(bench.x_train, "y")
    rows = bench.x_train.filter("y = 1").select(vector_to_array("features").alias("x")).collect()
    x = np.array([r.x for r in rows])
    assert np.allclose(model.theta.toArray()[1], x.mean(axis=0))
    assert np.allclose(model.sigma.toArray()[1], x.var(axis=0), atol=1e-6)


def test_reloaded_model_predicts_the_same(spark, bench):
    model = fit_rf(bench.x_train, "tactic_idx", **FOREST)
    path = scratch_dir(spark, "model")
    save_model(model, path)
    before, after = (score(m, bench.x_test).orderBy("uid").collect() for m in (model, load_model(path)))
    assert before == after


def broken(df, label):
    raise RuntimeError("no fit")


def test_one_failure_does_not_stop_the_rest(bench):
    result = train_all([ModelSpec("broken", broken), ModelSpec("nb", fit_gnb)], bench.x_train, bench.x_test, "y")
    status = {r.model: r.status for r in result.status.collect()}
    assert status == {"broken": "failed: RuntimeError: no fit", "nb": "ok"}
    assert list(result.models) == ["nb"]
    assert result.predictions.count() == bench.x_test.count()


def test_second_run_fits_nothing(spark, bench):
    root = scratch_dir(spark, "store")
    specs = [s for s in default_specs(FOREST) if s.name != "random_forest"]
    first = train_missing(specs, bench.x_train, bench.x_test, "tactic_idx", root, "tactic")
    assert {r.status for r in first.status.collect()} == {"ok"}
    again = train_missing(
        [ModelSpec(s.name, broken) for s in specs], bench.x_train, bench.x_test, "tactic_idx", root, "tactic",
    )
    assert {r.status for r in again.status.collect()} == {"loaded"}
    key = ["model", "uid"]
    assert first.predictions.orderBy(key).collect() == again.predictions.orderBy(key).collect()
    # A missing prediction file alone makes the model incomplete.
    mixed = [*specs[:1], ModelSpec("extra", fit_dt)]
    third = train_missing(mixed, bench.x_train, bench.x_test, "tactic_idx", root, "tactic")
    assert {r.model: r.status for r in third.status.collect()} == {specs[0].name: "loaded", "extra": "ok"}


def test_hierarchical_levels(bench):
    model = fit_hierarchical(bench.x_train, **FOREST)
    predictions = model.predict(bench.x_test)
    assert predictions.filter(F.col("joint") != F.concat("tactic", F.lit(" - "), F.split_part("joint", F.lit(" - "), F.lit(2)))).count() == 0
    got = {(r.level, r["class"]): r for r in hierarchical_report(predictions).collect()}
    assert got["tactic", "accuracy"].f1 >= got["joint", "accuracy"].f1
    assert got["joint", "accuracy"].support == bench.x_test.count()


def test_balanced_forest_is_judged_on_all_rows(bench):
    model = fit_balanced_rf(bench.x_train, "tactic_idx", **FOREST)
    assert score(model, bench.x_test, "tactic_idx").count() == bench.x_test.count()


def test_missing_labels_are_a_class_of_their_own(bench):
    blank = bench.x_train.filter("uid % 3 = 0").withColumn("label_technique", F.when(F.col("uid") % 2 > 0, F.col("label_technique")))
    model = fit_hierarchical(blank, numTrees=3, maxDepth=4)
    assert "None" in model.classes
    found = model.predict(blank)
    assert found.filter("joint is null or tactic is null or predicted_joint is null").count() == 0
    assert found.filter("joint = 'None'").count() > 0


def test_values_by_class_of_multinomial_models(spark, bench):
    lines = feature_importance(spark, bench.model("lr_tactic"), bench.names)
    assert lines.select("class").distinct().count() == len(bench.tactics)
    assert feature_importance(spark, bench.model("gnb_tactic"), bench.names).count() == len(bench.tactics) * len(bench.names)
