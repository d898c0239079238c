"""The plans keep rows where they are and move only aggregates."""

import re

import pytest
from pyspark.sql import functions as F

from flowlucid.explain.kernel import additive_kernel_shap, kernel_shap, kernel_shap_by_transform, row_background
from flowlucid.explain.tree import tree_shap
from flowlucid.functions import with_flow_features
from flowlucid.operators.models import report_predictions, score
from flowlucid.operators.prep import encode
from flowlucid.operators.sampling import stratified_split
from flowlucid.operators.weekly import weekly_counts
from flowlucid.plans import queries, workbench

from .test_sources import plan


def shuffles(df):
    """Shuffle exchanges outside cached relations, as written in the plan tree."""
    tree = plan(df).split("\n\n")[0]
    tree = re.split(r"InMemoryRelation", tree)[0]
    return len(re.findall(r"\bExchange\b", tree))


def test_narrow_stages_do_not_shuffle(bench):
    flows = with_flow_features(bench.flows)
    assert shuffles(flows) == 0
    assert shuffles(stratified_split(bench.features, "y")) == 0
    assert shuffles(encode(bench.prep, bench.split)) == 0
    assert shuffles(score(bench.model("dt_binary"), bench.x_test, "y")) == 0


def test_attributions_do_not_shuffle(bench):
    assert shuffles(tree_shap(bench.model("dt_binary"), bench.x_test, 1)) == 0
    background = row_background(bench.x_train, 5)
    assert shuffles(additive_kernel_shap(bench.model("lr_binary"), bench.x_test, background, n_samples=64)) == 0


def test_kernel_values_need_at_most_one_shuffle(bench):
    background = row_background(bench.x_train, 5)
    for name in ("dt_binary", "gnb_binary"):
        assert shuffles(kernel_shap(bench.model(name), encode(bench.prep, bench.test), background, n_samples=64)) == 0
    # The kept rows are partitioned by key already; fresh rows are spread by key once.
    assert shuffles(kernel_shap_by_transform(bench.model("dt_binary"), bench.x_test, background, n_samples=64)) == 0
    fresh = encode(bench.prep, bench.test)
    assert shuffles(kernel_shap_by_transform(bench.model("dt_binary"), fresh, background, n_samples=64)) == 1


def test_report_shuffles_confusion_counts_only(bench):
    rows = score(bench.model("dt_binary"), bench.x_test, "y").withColumn("model", F.lit("m"))
    text = plan(report_predictions(rows))
    assert re.search(r"Keys \[\d\]: \[.*label.*prediction.*\]\nFunctions \[1\]: \[partial_count\(1\)\]", text)


def test_labels_of_two_levels_need_no_join(spark, bench):
    """They are kept beside the encoded rows; only a uid that comes again is joined, null ones have no row."""
    assert "Join" not in plan(bench.two_levels).split("InMemoryRelation")[0]
    of_rule = bench.two_levels.join(bench.split.select("uid", "conn_state", "proto"), "uid")
    assert of_rule.count() == bench.split.count()
    assert of_rule.filter("(label_tactic = 'open') <> (conn_state = 'SF') or (label_technique = 'T1') <> (proto = 'icmp')").isEmpty()
    odd = workbench.Workbench(spark, bench.sf_dir)
    schema = "uid long, label_tactic string, label_technique string, label_tactic_level string, label_technique_level string, n int"
    odd.__dict__["encoded"] = spark.createDataFrame([(1, "a", "b", "open", "T1", 1), (1, "a", "b", "other", "T2", 2), (2, "a", "b", "open", "T2", 3), (None, "a", "b", "open", "T1", 4)], schema)
    got = sorted((r.uid, r.n, r.label_tactic, r.label_technique) for r in odd.two_levels.collect())
    assert got == [(1, 1, "open", "T1"), (1, 1, "other", "T2"), (1, 2, "open", "T1"), (1, 2, "other", "T2"), (2, 3, "open", "T2")]
    assert odd.two_levels.columns == ["uid", "n", "label_tactic", "label_technique"]


def test_weekly_counts_read_two_columns(bench):
    text = plan(weekly_counts(bench.flows, "label_tactic"))
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert schema == "struct<ts:timestamp_ntz,event_type:string>"
    assert shuffles(weekly_counts(bench.flows, "label_tactic")) == 1


def test_registered_models_and_kernels_use_the_defaults(bench, monkeypatch):
    asked = {}

    class Asked(Exception):
        pass

    def noted(name):
        def call(*args, **options):
            asked[name] = args, options
            raise Asked
        return call

    monkeypatch.setattr(workbench, "fit_rf", noted("fit_rf"))
    monkeypatch.setattr(queries, "kernel_shap", noted("kernel"))
    monkeypatch.setattr(queries, "additive_kernel_shap", noted("additive"))
    fresh = workbench.Workbench(bench.spark, bench.sf_dir)
    with pytest.raises(Asked):
        fresh.model("rf_binary")
    assert not asked["fit_rf"][1]
    for name, call in (("kernel_shap_model_total", "kernel"), ("kernel_shap_nb_total", "additive")):
        with pytest.raises(Asked):
            queries.registered()[name](bench.spark, bench.sf_dir)
        assert not asked[call][1] and len(asked[call][0][2].x) == 100
