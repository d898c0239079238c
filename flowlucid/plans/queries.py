"""One registered query per operator. Each reads the whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import scratch_dir, small_table
from ..explain.dependence import partial_dependence, pdp_grid
from ..explain.importance import compare_importance, feature_importance, lr_gradient, split_gains
from ..explain.kernel import additive_kernel_shap, kernel_shap, kmeans_background, row_background
from ..explain.lime import lime, lime_moments, quantile_bins
from ..explain.summary import long_form, only_supported, shap_points, shap_summary
from ..explain.tree import interaction_summary, tree_shap, tree_shap_interactions
from ..functions import encode_binary, joint_label, safe_div, tactic_of
from ..operators.models import (
    ModelSpec, default_specs, fit_balanced_rf, fit_dt, fit_gnb, fit_hierarchical, fit_lr, fit_rf, hierarchical_report,
    report_predictions, score, train_all, train_missing,
)
from ..operators.prep import impute_mean, impute_mode, with_class_weight
from ..operators.report import classification_report, confusion, confusion_wide
from ..operators.sampling import sample_n, top_features, undersample
from ..operators.summary import (
    class_profile, class_support, distinct_labels, filter_tactics, first_n, label_counts, label_index, nth_row,
    select_model_columns, shape,
)
from ..operators.weekly import sheet_to_long, weekly_bounds, weekly_counts, weekly_sheet
from ..schema import CATEGORICAL, NUMERIC
from ..sources import (
    load_model, load_predictions, read_flows, register_view, save_model, save_predictions, save_report,
    write_metric_sheet, write_weekly_flows,
)
from .workbench import Workbench, workbench

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(name: str):
    def register(fn: Callable[[Workbench], DataFrame]) -> Callable[[Workbench], DataFrame]:
        _registry[name] = lambda spark, sf_dir: fn(workbench(spark, sf_dir))
        return fn

    return register


def registered() -> dict[str, Query]:
    return dict(_registry)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


# Flagship --------------------------------------------------------------------------------


@query("flow_profile")
def flow_profile(w: Workbench) -> DataFrame:
    """Rows and mean rates per binary label."""
    return rounded(w.features.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("pktAtsec", "BitRate", "interTime", "avgLenPkt")],
    ), 4)


# Scans, sources, sinks -------------------------------------------------------------------


@query("scan_flows")
def scan_flows(w: Workbench) -> DataFrame:
    root = scratch_dir(w.spark, "flows")
    write_weekly_flows(w.flows, root)
    rows = read_flows(w.spark, f"{root}/week=*")
    return rows.groupBy("label_tactic", "proto").agg(
        F.count(F.lit(1)).alias("n"), F.sum("orig_bytes").alias("orig_bytes"), F.min("ts").alias("first_ts"),
    )


@query("register_view")
def register_flows_view(w: Workbench) -> DataFrame:
    register_view(w.flows, "flows")
    return w.spark.sql(
        "SELECT proto, service, count(*) AS n, sum(orig_pkts) AS pkts FROM flows GROUP BY proto, service"
    )


def _stored_predictions(w: Workbench, model: str) -> str:
    root = scratch_dir(w.spark, "store")
    save_predictions(score(w.model(model), w.x_test, "y"), root, "binary", model)
    return root


@query("write_predictions")
def write_predictions(w: Workbench) -> DataFrame:
    root = _stored_predictions(w, "gnb_binary")
    stored = w.spark.read.parquet(f"{root}/predictions")
    return stored.select("uid", "task", "model", "label", "prediction")


@query("read_predictions")
def read_predictions(w: Workbench) -> DataFrame:
    root = _stored_predictions(w, "gnb_binary")
    save_predictions(score(w.model("dt_binary"), w.x_test, "y"), root, "binary", "dt_binary")
    stored = load_predictions(w.spark, root, "binary", ["gnb_binary"])
    return stored.groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("save_model")
def save_model_files(w: Workbench) -> DataFrame:
    path = scratch_dir(w.spark, "model")
    save_model(w.model("gnb_binary"), path)
    return score(load_model(path), w.x_test, "y").select("uid", "label", "prediction")


@query("load_model")
def load_model_files(w: Workbench) -> DataFrame:
    path = scratch_dir(w.spark, "model")
    save_model(w.model("gnb_tactic"), path)
    return score(load_model(path), w.x_test, "tactic_idx").select("uid", "label", "prediction")


@query("save_report")
def save_report_files(w: Workbench) -> DataFrame:
    path = scratch_dir(w.spark, "report")
    save_report(_binary_report(w), path)
    return w.spark.read.parquet(path)


@query("resume_missing")
def resume_missing(w: Workbench) -> DataFrame:
    root = scratch_dir(w.spark, "store")
    specs = default_specs()
    first = train_missing(specs[:2], w.x_train, w.x_test, "tactic_idx", root, "tactic")
    second = train_missing(specs, w.x_train, w.x_test, "tactic_idx", root, "tactic")
    runs = first.status.withColumn("run", F.lit(1)).unionByName(second.status.withColumn("run", F.lit(2)))
    rows = second.predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n_predictions"))
    return runs.join(rows, "model", "left").select("run", "model", "status", "n_predictions")


@query("metrics_csv")
def metrics_csv(w: Workbench) -> DataFrame:
    path = scratch_dir(w.spark, "sheet")
    write_metric_sheet(weekly_sheet(w.flows, "label_tactic"), path)
    return sheet_to_long(w.spark.read.option("header", True).csv(path))


# Projections, filters, scalar expressions ------------------------------------------------


@query("project_flows")
def project_flows(w: Workbench) -> DataFrame:
    return select_model_columns(w.flows)


@query("filter_tactics")
def filter_tactic_rows(w: Workbench) -> DataFrame:
    return filter_tactics(w.flows, ["Discovery", "Reconnaissance"]).select("uid", "label_tactic", "proto")


@query("safe_div")
def safe_division(w: Workbench) -> DataFrame:
    return w.flows.select("uid", safe_div("resp_bytes", "duration").alias("ratio"))


@query("feat_pkt_rate")
def feat_pkt_rate(w: Workbench) -> DataFrame:
    return w.features.select("uid", "pktAtsec")


@query("feat_bit_rate")
def feat_bit_rate(w: Workbench) -> DataFrame:
    return w.features.select("uid", "BitRate")


@query("feat_inter_time")
def feat_inter_time(w: Workbench) -> DataFrame:
    return w.features.select("uid", "interTime")


@query("feat_avg_len")
def feat_avg_len(w: Workbench) -> DataFrame:
    return w.features.select("uid", "avgLenPkt")


@query("feat_totals")
def feat_totals(w: Workbench) -> DataFrame:
    return w.features.select("uid", "numPKT", "numBytes")


@query("label_binary")
def label_binary(w: Workbench) -> DataFrame:
    return w.flows.select("uid", "label_binary", encode_binary(w.flows).alias("y"))


@query("label_joint")
def label_joint(w: Workbench) -> DataFrame:
    return w.flows.select("uid", joint_label().alias("label_joint"))


@query("head_rows")
def head_rows(w: Workbench) -> DataFrame:
    return first_n(select_model_columns(w.test), 100)


@query("row_pick")
def row_pick(w: Workbench) -> DataFrame:
    return nth_row(select_model_columns(w.test), 50)


@query("shape")
def table_shape(w: Workbench) -> DataFrame:
    return shape(select_model_columns(w.flows, keep=()))


# Aggregations ----------------------------------------------------------------------------


@query("count_by_label")
def count_by_label(w: Workbench) -> DataFrame:
    return label_counts(w.flows, "label_binary")


@query("class_support")
def class_supports(w: Workbench) -> DataFrame:
    # A class that no row carries shows as zero.
    return class_support(w.split, "label_tactic", [*w.tactics, "Collection"])


@query("distinct_labels")
def distinct_label_sets(w: Workbench) -> DataFrame:
    predicted = score(w.model("gnb_tactic"), w.x_test).select(F.col("prediction").alias("c"))
    sides = [
        ("train", distinct_labels(w.x_train.select(F.col("tactic_idx").alias("c")), "c")),
        ("test", distinct_labels(w.x_test.select(F.col("tactic_idx").alias("c")), "c")),
        ("predicted", distinct_labels(predicted, "c")),
    ]
    (first, rows), *rest = sides
    out = rows.select(F.lit(first).alias("side"), "c")
    for name, rows in rest:
        out = out.unionByName(rows.select(F.lit(name).alias("side"), "c"))
    return out


@query("confusion_matrix")
def confusion_matrix(w: Workbench) -> DataFrame:
    return confusion(score(w.model("gnb_tactic"), w.x_test, "tactic_idx"))


@query("confusion_matrix_wide")
def confusion_matrix_wide(w: Workbench) -> DataFrame:
    return confusion_wide(score(w.model("gnb_binary"), w.x_test, "y"), [0, 1]).select(
        "actual", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"),
    )


def _binary_report(w: Workbench) -> DataFrame:
    return rounded(classification_report(score(w.model("gnb_binary"), w.x_test, "y")))


@query("class_report")
def class_report(w: Workbench) -> DataFrame:
    return _binary_report(w)


@query("class_report_tactic")
def class_report_tactic(w: Workbench) -> DataFrame:
    """The full class list is given, with one class that has no rows: it counts in the macro mean."""
    names = [*w.tactics, "Collection"]
    predictions = score(w.model("gnb_tactic"), w.x_test, "tactic_idx")
    return rounded(classification_report(predictions, labels=range(len(names)), names=names))


@query("class_report_partial")
def class_report_partial(w: Workbench) -> DataFrame:
    """Only some classes are listed; the accuracy is still that of all rows."""
    predictions = score(w.model("gnb_tactic"), w.x_test, "tactic_idx")
    return rounded(classification_report(predictions, labels=[0, 1], names=w.tactics[:2]))


@query("class_report_empty")
def class_report_empty(w: Workbench) -> DataFrame:
    """No rows, but a class list: every class with support 0, and the summary lines."""
    predictions = score(w.model("gnb_tactic"), w.x_test.filter("uid < 0"), "tactic_idx")
    return rounded(classification_report(predictions, labels=range(len(w.tactics)), names=w.tactics))


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("week_start", F.col("week_start").cast("string"))


@query("weekly_counts")
def weekly_label_counts(w: Workbench) -> DataFrame:
    return _dates_as_text(weekly_counts(w.flows, "label_technique"))


@query("weekly_bounds")
def weekly_record_bounds(w: Workbench) -> DataFrame:
    return _dates_as_text(weekly_bounds(w.flows))


@query("weekly_sheet_long")
def weekly_sheet_long(w: Workbench) -> DataFrame:
    return sheet_to_long(weekly_sheet(w.flows, "label_technique"))


@query("weekly_sheet")
def weekly_sheet_wide(w: Workbench) -> DataFrame:
    return weekly_sheet(w.flows, "label_binary")


@query("class_profile")
def class_feature_profile(w: Workbench) -> DataFrame:
    return rounded(class_profile(w.train, "y", NUMERIC), 4)


# Ranking, splits, samples ----------------------------------------------------------------


@query("label_encode")
def label_encode(w: Workbench) -> DataFrame:
    return label_index(w.flows, "label_tactic", "tactic_idx").select("uid", "label_tactic", "tactic_idx")


@query("split_stratified")
def split_stratified(w: Workbench) -> DataFrame:
    return w.split.select("uid", "y", "is_test")


@query("undersample")
def undersample_classes(w: Workbench) -> DataFrame:
    return undersample(w.train, "label_tactic").select("uid", "label_tactic")


@query("sample_rows")
def sample_rows(w: Workbench) -> DataFrame:
    return sample_n(w.test, 1000).select("uid", "y")


def _fixed_attributions(w: Workbench) -> DataFrame:
    """Attributions of the score "sum of encoded features": each feature's own value."""
    return w.x_test.select("uid", F.col("y").alias("class"), vector_to_array("features").alias("values"))


@query("topk_features")
def topk_features(w: Workbench) -> DataFrame:
    ranked = top_features(shap_summary(_fixed_attributions(w), w.names), 10)
    return rounded(ranked.select("class", "feature", "rank", "mean_abs"))


# Feature preparation ---------------------------------------------------------------------


@query("impute_mean")
def impute_mean_columns(w: Workbench) -> DataFrame:
    # Only the filled-in value is rounded; present values pass through unchanged.
    means = {c: round(m, 6) for c, m in w.stats.mean.items()}
    return impute_mean(w.split, means).select("uid", *NUMERIC)


@query("impute_mode")
def impute_mode_columns(w: Workbench) -> DataFrame:
    return impute_mode(w.split, w.stats.mode).select("uid", *CATEGORICAL)


def _encoded_columns(w: Workbench) -> DataFrame:
    x = vector_to_array("features")
    return w.encoded.select("uid", *[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(w.names)])


@query("standardize")
def standardize(w: Workbench) -> DataFrame:
    return rounded(_encoded_columns(w).select("uid", *NUMERIC))


@query("one_hot")
def one_hot(w: Workbench) -> DataFrame:
    slots = [n for n in w.names if n not in NUMERIC]
    return _encoded_columns(w).select("uid", *[F.col(n).cast("int").alias(n) for n in slots])


@query("assemble")
def assemble(w: Workbench) -> DataFrame:
    """The assembled vector, slot by slot, by label: count, sum and largest value."""
    x = F.posexplode(vector_to_array("features")).alias("slot", "value")
    return w.encoded.select("y", x).groupBy("y", "slot").agg(
        F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("largest"),
    )


@query("feature_names")
def feature_name_table(w: Workbench) -> DataFrame:
    """Names in vector order, with the mean of their slot over the train rows."""
    means = w.x_train.agg(*[
        F.avg(F.get(vector_to_array("features"), F.lit(i))).alias(n) for i, n in enumerate(w.names)
    ])
    rows = means.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("slot"), F.lit(n).alias("feature"), F.col(n).alias("train_mean"))
        for i, n in enumerate(w.names)
    ])))
    # Adding zero turns a rounded -0.0 into 0.0.
    return rows.select("slot", "feature", (F.round("train_mean", 6) + F.lit(0.0)).alias("train_mean"))


@query("class_weights")
def class_weights(w: Workbench) -> DataFrame:
    return rounded(with_class_weight(w.train, "label_tactic").select("uid", "label_tactic", "weight"))


# Models ----------------------------------------------------------------------------------


def _predictions(w: Workbench, model: str, label: str) -> DataFrame:
    return score(w.model(model), w.x_test, label)


def _model_query(name: str, label: str) -> None:
    @query(name)
    def run(w: Workbench) -> DataFrame:
        return _predictions(w, name, label).select("uid", "label", "prediction")


for _name in ("rf", "dt", "lr", "gnb"):
    _model_query(f"{_name}_binary", "y")
    _model_query(f"{_name}_tactic", "tactic_idx")
for _name in ("rf", "dt", "lr"):
    _model_query(f"{_name}_rule", "rule")
_model_query("rf_signal", "signal")


@query("predict")
def predict(w: Workbench) -> DataFrame:
    rows = _predictions(w, "gnb_binary", "y")
    return rows.select("uid", "prediction", F.round(F.get("probability", F.lit(1)), 6).alias("p_attack"))


@query("train_all")
def train_all_models(w: Workbench) -> DataFrame:
    """Each model's status beside its report; a failed one has a line of its own."""
    result = train_all(default_specs(), w.x_train, w.x_test, "y")
    return result.status.join(report_predictions(result.predictions), "model", "left")


@query("train_all_tactic")
def train_all_tactic(w: Workbench) -> DataFrame:
    result = train_all(default_specs(), w.x_train, w.x_test, "tactic_idx")
    return result.status.join(report_predictions(result.predictions, w.tactics), "model", "left")


@query("hier_predict")
def hier_predict(w: Workbench) -> DataFrame:
    return hierarchical_report(w.model("hierarchical").predict(w.x_test))


@query("hier_rollup")
def hier_rollup(w: Workbench) -> DataFrame:
    """The roll-up step on the actual joint labels."""
    joint = w.flows.select(joint_label().alias("joint"))
    return joint.select("joint", tactic_of("joint").alias("tactic")).groupBy("joint", "tactic").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("balanced_rf")
def balanced_rf(w: Workbench) -> DataFrame:
    predictions = _predictions(w, "balanced_rf", "tactic_idx")
    return classification_report(predictions, labels=range(len(w.tactics)), names=w.tactics)


@query("hier_rule")
def hier_rule(w: Workbench) -> DataFrame:
    """Both reports of a forest on labels that follow from the features: every score is one."""
    rows = w.two_levels
    model = fit_hierarchical(rows.filter(~F.col("is_test")))
    return rounded(hierarchical_report(model.predict(rows.filter("is_test"))))


@query("balanced_rf_rule")
def balanced_rf_rule(w: Workbench) -> DataFrame:
    predictions = score(fit_balanced_rf(w.x_train, "rule"), w.x_test, "rule")
    return rounded(classification_report(predictions, labels=range(2), names=["no", "yes"]))


@query("train_all_rule")
def train_all_rule(w: Workbench) -> DataFrame:
    """Status and report of three models that learn the rule and of one that cannot be fitted."""
    def broken(df: DataFrame, label: str):
        raise ValueError("no fit")

    specs = [ModelSpec("forest", fit_rf), ModelSpec("broken", broken), ModelSpec("tree", fit_dt), ModelSpec("logistic", fit_lr)]
    result = train_all(specs, w.x_train, w.x_test, "rule")
    return rounded(result.status.join(report_predictions(result.predictions, ["no", "yes"]), "model", "left"))


@query("dt_stump")
def dt_stump(w: Workbench) -> DataFrame:
    """Class and probability of a tree of one split."""
    scored = score(w.model("stump_rule"), w.x_test, "rule")
    return scored.select("uid", "label", "prediction", F.round(F.get("probability", F.lit(1)), 9).alias("p_rule"))


@query("importance_stump")
def importance_stump(w: Workbench) -> DataFrame:
    return rounded(feature_importance(w.spark, w.model("stump_rule"), w.names))


@query("split_gains")
def split_gain_table(w: Workbench) -> DataFrame:
    """The exact gain of splitting all train rows just above the mean of scaled slots, or between 0 and 1."""
    cuts = {i: [0.05 if n in NUMERIC else 0.5] for i, n in enumerate(w.names)}
    gains = split_gains(w.x_train, "rule", cuts)
    return gains.select("slot", F.round("gain", 9).alias("gain"))


@query("lr_gradient")
def lr_gradient_sums(w: Workbench) -> DataFrame:
    """What the fitted probabilities add up to by feature, which at the optimum is what the labels do."""
    rows = with_class_weight(w.x_train, "y")
    sums = lr_gradient(w.model("lr_binary"), rows, "y", F.col("weight"), w.names)
    n = w.x_train.count()
    return sums.select("feature", (F.round(F.col("fitted") / n, 4) + F.lit(0.0)).alias("moment"))


@query("lr_closed_form")
def lr_closed_form(w: Workbench) -> DataFrame:
    """A hardly penalised fit on one categorical column: its probabilities are weighted class shares."""
    slots = [i for i, n in enumerate(w.names) if n.startswith("conn_state_")]
    part = VectorSlicer(inputCol="all", outputCol="features", indices=slots)
    train = part.transform(w.x_train.select("uid", "y", F.col("features").alias("all")))
    scored = score(fit_lr(train, "y", C=1e9), part.transform(w.x_test.select("uid", "y", F.col("features").alias("all"))))
    return scored.select("uid", F.round(F.get("probability", F.lit(1)), 3).alias("p_attack"))


# Explanations ----------------------------------------------------------------------------


def _tree_attributions(w: Workbench, name: str, class_: int | None) -> DataFrame:
    return tree_shap(w.model(name), w.x_test, class_, paths=w.paths(name))


@query("tree_shap_rf_binary")
def tree_shap_rf_binary(w: Workbench) -> DataFrame:
    return long_form(_tree_attributions(w, "rf_binary", 1), w.names)


@query("tree_shap_dt_binary")
def tree_shap_dt_binary(w: Workbench) -> DataFrame:
    return long_form(_tree_attributions(w, "dt_binary", 1), w.names)


def _tactic_summary(w: Workbench, name: str) -> DataFrame:
    summary = shap_summary(_tree_attributions(w, name, None), w.names)
    support = w.x_test.groupBy(F.col("tactic_idx").alias("class")).agg(F.count(F.lit(1)).alias("n_test"))
    return only_supported(summary, support)


@query("tree_shap_rf_tactic")
def tree_shap_rf_tactic(w: Workbench) -> DataFrame:
    return _tactic_summary(w, "rf_tactic")


@query("tree_shap_dt_tactic")
def tree_shap_dt_tactic(w: Workbench) -> DataFrame:
    return _tactic_summary(w, "dt_tactic")


@query("tree_shap_hier")
def tree_shap_hier(w: Workbench) -> DataFrame:
    return shap_summary(_tree_attributions(w, "balanced_rf", 1), w.names)


@query("tree_shap_hier_points")
def tree_shap_hier_points(w: Workbench) -> DataFrame:
    """Every attribution beside the encoded value it explains."""
    return shap_points(_tree_attributions(w, "balanced_rf", 1), w.x_test, w.names)


@query("tree_shap_interaction")
def tree_shap_interaction(w: Workbench) -> DataFrame:
    """Mean |interaction value| per pair of features over all test rows; zero where no path holds both."""
    found = interaction_summary(w.model("rf_binary"), w.x_test, 1, paths=w.paths("rf_binary")).drop("class")
    names = list(enumerate(w.names))
    pairs = small_table(w.spark, [(f"{a} x {b}", min(i, j), max(i, j)) for i, a in names for j, b in names], "feature string, first int, second int")
    return pairs.join(found, ["first", "second"], "left").select(F.lit(1).alias("class"), "feature", F.coalesce("mean_abs", F.lit(0.0)).alias("mean_abs"))


@query("tree_shap_rule")
def tree_shap_rule(w: Workbench) -> DataFrame:
    """Every attribution of a tree whose values are known in closed form."""
    values = long_form(_tree_attributions(w, "dt_rule", 1), w.names)
    return values.select("uid", "feature", (F.round("value", 9) + F.lit(0.0)).alias("value"))


@query("tree_shap_rf_signal")
def tree_shap_rf_signal(w: Workbench) -> DataFrame:
    return long_form(_tree_attributions(w, "rf_signal", 1), w.names)


@query("tree_shap_interaction_signal")
def tree_shap_interaction_signal(w: Workbench) -> DataFrame:
    return interaction_summary(w.model("rf_signal"), w.x_test, 1, paths=w.paths("rf_signal"))


@query("lime_signal")
def lime_signal(w: Workbench) -> DataFrame:
    return lime(w.model("rf_signal"), w.x_train, nth_row(w.x_test, 50), w.names, paths=w.paths("rf_signal"))


@query("pdp_signal")
def pdp_signal(w: Workbench) -> DataFrame:
    models = {name: w.model(name) for name in ("rf_signal", "dt_signal", "lr_signal", "gnb_signal")}
    paths = {name: w.paths(name) for name in ("rf_signal", "dt_signal")}
    return partial_dependence(models, w.x_test, w.names, [w.names.index(c) for c in PDP_FEATURES], paths=paths)


@query("tree_shap_rf_rule")
def tree_shap_rf_rule(w: Workbench) -> DataFrame:
    """Base plus attributions of a forest of 100 trees: its probability, which is the rule."""
    values = _tree_attributions(w, "rf_rule", 1)
    total = F.col("base") + F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return values.select("uid", F.round(total, 0).cast("int").alias("rule"))


@query("tree_shap_interaction_rule")
def tree_shap_interaction_rule(w: Workbench) -> DataFrame:
    values = tree_shap_interactions(w.model("dt_rule"), w.x_test, 1, paths=w.paths("dt_rule"))
    a, b, m = w.names.index("conn_state_SF"), w.names.index("proto_icmp"), len(w.names)
    slots = F.transform(F.arrays_zip("first", "second"), lambda p: p["first"] * m + p["second"])
    known = values.withColumn("by_slot", F.map_from_arrays(slots, F.col("values")))

    def slot(i: int, j: int, name: str) -> Column:
        value = F.coalesce(F.try_element_at("by_slot", F.lit(min(i, j) * m + max(i, j))), F.lit(0.0))
        return (F.round(value, 9) + F.lit(0.0)).alias(name)

    return known.select("uid", slot(a, b, "between"), slot(b, a, "between_back"), slot(a, a, "own_state"), slot(b, b, "own_proto"))


@query("kernel_shap_lr")
def kernel_shap_lr(w: Workbench) -> DataFrame:
    background = kmeans_background(w.x_train, 100)
    return long_form(additive_kernel_shap(w.model("lr_binary"), w.x_test, background), w.names)


@query("kernel_shap_nb")
def kernel_shap_nb(w: Workbench) -> DataFrame:
    background = row_background(w.x_train, 100)
    return long_form(additive_kernel_shap(w.model("gnb_binary"), w.x_test, background), w.names)


@query("kernel_shap_nb_total")
def kernel_shap_nb_total(w: Workbench) -> DataFrame:
    """Base plus the sum of a row's attributions: the model's probability."""
    values = additive_kernel_shap(w.model("gnb_binary"), w.x_test, row_background(w.x_train, 100))
    total = F.col("base") + F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return values.select("uid", F.round(total, 6).alias("p_attack"))


@query("kernel_shap_model_total")
def kernel_shap_model_total(w: Workbench) -> DataFrame:
    """The estimate for any model, here a tree: base plus attributions is the probability."""
    background = row_background(w.x_train, 100)
    values = kernel_shap(w.model("dt_rule"), w.x_test, background)
    total = F.col("base") + F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return values.select("uid", (F.round(total, 6) + F.lit(0.0)).alias("p_rule"))


@query("kernel_shap_rule")
def kernel_shap_rule(w: Workbench) -> DataFrame:
    """Every attribution of the estimate for a model with one interaction, where it is exact."""
    values = long_form(kernel_shap(w.model("dt_rule"), w.x_test, row_background(w.x_train, 100)), w.names)
    return values.select("uid", "feature", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("kmeans_background")
def kmeans_background_centres(w: Workbench) -> DataFrame:
    background = kmeans_background(w.x_train, 100)
    rows = [(i, float(b), x.tolist()) for i, (b, x) in enumerate(zip(background.weight, background.x, strict=True))]
    return small_table(w.spark, rows, "centre int, weight double, x array<double>")


@query("kmeans_background_values")
def kmeans_background_values(w: Workbench) -> DataFrame:
    """By feature: coordinates of centres that occur nowhere in the train rows, and the centres' whole weight."""
    background = kmeans_background(w.x_train, 100)
    centres = small_table(w.spark, [(j, float(v)) for x in background.x for j, v in enumerate(x)], "slot int, v double")
    known = w.x_train.select(F.posexplode(vector_to_array("features")).alias("slot", "v")).distinct().withColumn("known", F.lit(True))
    missing = centres.join(known, ["slot", "v"], "left").groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_centres"), F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("n_missing"),
    )
    return missing.withColumn("weight", F.lit(round(float(background.weight.sum()), 9)))


@query("shap_global")
def shap_global(w: Workbench) -> DataFrame:
    return rounded(shap_summary(_fixed_attributions(w), w.names))


@query("shap_points")
def shap_point_table(w: Workbench) -> DataFrame:
    return rounded(shap_points(_fixed_attributions(w), w.x_test, w.names))


@query("shap_global_rf")
def shap_global_rf(w: Workbench) -> DataFrame:
    """The data behind the bar plot: the ten features of largest mean |attribution|."""
    return top_features(shap_summary(_tree_attributions(w, "rf_binary", None), w.names), 10)


@query("lime_local")
def lime_local(w: Workbench) -> DataFrame:
    return lime(w.model("rf_binary"), w.x_train, nth_row(w.x_test, 50), w.names, paths=w.paths("rf_binary"))


@query("lime_moments")
def lime_moment_sums(w: Workbench) -> DataFrame:
    """The sums behind the local fit, for the rule's tree."""
    found = lime_moments(w.model("dt_rule"), w.x_train, nth_row(w.x_test, 50), len(w.names), paths=w.paths("dt_rule"))
    return rounded(found)


@query("lime_discretizer")
def lime_discretizer(w: Workbench) -> DataFrame:
    bins = quantile_bins(w.train, NUMERIC)
    return rounded(bins.select("feature", "bin", "n", "share", "mean", "std"))


PDP_FEATURES = ["orig_pkts", "resp_pkts", "pktAtsec", "avgLenPkt"]


def _pdp_columns(w: Workbench) -> DataFrame:
    x = vector_to_array("features")
    return w.x_test.select(*[F.get(x, F.lit(w.names.index(c))).alias(c) for c in PDP_FEATURES])


@query("pdp")
def pdp(w: Workbench) -> DataFrame:
    """All four binary models over one grid, in one pass."""
    models = {name: w.model(name) for name in ("rf_binary", "dt_binary", "lr_binary", "gnb_binary")}
    paths = {name: w.paths(name) for name in ("rf_binary", "dt_binary")}
    return partial_dependence(models, w.x_test, w.names, [w.names.index(c) for c in PDP_FEATURES], paths=paths)


@query("pdp_nb")
def pdp_nb(w: Workbench) -> DataFrame:
    curve = partial_dependence(w.model("gnb_binary"), w.x_test, w.names, [w.names.index(c) for c in PDP_FEATURES])
    return curve.select("feature", "position", F.round("avg_probability", 6).alias("avg_probability"))


@query("pdp_rule")
def pdp_rule(w: Workbench) -> DataFrame:
    slots = [w.names.index("conn_state_SF"), w.names.index("proto_icmp")]
    curve = partial_dependence(w.model("dt_rule"), w.x_test, w.names, slots)
    return rounded(curve.select("feature", "grid_value", "avg_probability"))


@query("pdp_grid")
def pdp_grid_points(w: Workbench) -> DataFrame:
    return rounded(pdp_grid(_pdp_columns(w), PDP_FEATURES))


@query("importance_tree")
def importance_tree(w: Workbench) -> DataFrame:
    forest = feature_importance(w.spark, w.model("rf_binary"), w.names).withColumn("model", F.lit("random_forest"))
    tree = feature_importance(w.spark, w.model("dt_binary"), w.names).withColumn("model", F.lit("decision_tree"))
    return forest.unionByName(tree)


@query("importance_tree_rule")
def importance_tree_rule(w: Workbench) -> DataFrame:
    return rounded(feature_importance(w.spark, w.model("dt_rule"), w.names))


@query("importance_lr")
def importance_lr(w: Workbench) -> DataFrame:
    return feature_importance(w.spark, w.model("lr_binary"), w.names)


@query("importance_nb")
def importance_nb(w: Workbench) -> DataFrame:
    return rounded(feature_importance(w.spark, w.model("gnb_binary"), w.names))


@query("importance_all")
def importance_all(w: Workbench) -> DataFrame:
    models = {
        "random_forest": w.model("rf_binary"), "decision_tree": w.model("dt_binary"),
        "logistic_regression": w.model("lr_binary"), "naive_bayes": w.model("gnb_binary"),
    }
    return compare_importance(w.spark, models, w.names)
