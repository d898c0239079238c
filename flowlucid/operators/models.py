"""Four classifiers on the encoded features, fitted by Spark ML.

Train and test frames carry ``features`` and an integer label. A frame passed to
several fits should be persisted by the caller once (``train_all`` does so).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import can_checkpoint, small_table
from ..functions import joint_label, label_text, tactic_of
from ..schema import KEY
from ..sources.store import (
    is_complete, load_model, load_predictions, model_path, save_model, save_predictions,
)
from .prep import balanced_weights, with_class_weight
from .report import classification_report
from .sampling import attach_by_class, class_counts, undersample
from .summary import classes_of, index_of, label_at


def fit_rf(
    df: DataFrame, label: str, balanced: bool = True, numTrees: int = 100, maxDepth: int = 20, seed: int = 42,
    **params,
) -> Model:
    """Random forest; class weights are balanced by default.

    Each row's node in every tree is kept beside it where such lists can be checkpointed: without
    them the trees grown so far go to every task of every pass. The forest is the same.
    """
    rows = with_class_weight(df, label) if balanced else df
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=numTrees, maxDepth=maxDepth, seed=seed,
        featureSubsetStrategy="sqrt", impurity="gini", maxMemoryInMB=256,
        **{"cacheNodeIds": can_checkpoint(df.sparkSession), **params},
    )
    return (forest.setWeightCol("weight") if balanced else forest).fit(rows)


def fit_dt(df: DataFrame, label: str, maxDepth: int = 5, seed: int = 42, **params) -> Model:
    return DecisionTreeClassifier(
        featuresCol="features", labelCol=label, maxDepth=maxDepth, seed=seed, impurity="gini",
        maxMemoryInMB=256, **params,
    ).fit(df)


def fit_lr(
    df: DataFrame, label: str, C: float = 1.0, maxIter: int = 1000, family: str = "auto", tol: float = 1e-6,
) -> Model:
    """Balanced L2 logistic regression: minimises |w|^2 / 2 + C * (weighted log loss).

    Spark averages the loss over the weights, which balanced weights make sum to the row
    count, so the same optimum needs regParam = 1 / (C * rows).
    """
    counts = class_counts(df, label)
    n = sum(counts.values())
    rows = attach_by_class(df, label, balanced_weights(counts), "weight", T.DoubleType())
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", family=family, maxIter=maxIter, tol=tol,
        regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False,
    ).fit(rows)


def fit_gnb(df: DataFrame, label: str) -> Model:
    """Gaussian naive Bayes; Spark applies the variance floor of 1e-9 times the largest variance."""
    return NaiveBayes(featuresCol="features", labelCol=label, modelType="gaussian").fit(df)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    fit: Callable[[DataFrame, str], Model]


def default_specs(forest: dict | None = None) -> list[ModelSpec]:
    """The four models of both tasks; ``forest`` overrides forest parameters."""
    options = forest or {}
    return [
        ModelSpec("random_forest", lambda df, y: fit_rf(df, y, **options)),
        ModelSpec("decision_tree", fit_dt),
        ModelSpec("logistic_regression", fit_lr),
        ModelSpec("naive_bayes", fit_gnb),
    ]


def score(model: Model, df: DataFrame, label: str | None = None, key: str = KEY) -> DataFrame:
    """Predicted class and class probabilities per row: a narrow transformation."""
    scored = model.transform(df)
    return scored.select(
        key,
        *([F.col(label).cast("int").alias("label")] if label else []),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
    )


def _attempt(work: Callable[[], object]) -> tuple[object, str]:
    try:
        return work(), "ok"
    except Exception as error:  # one model's failure must not stop the others
        return None, f"failed: {type(error).__name__}: {str(error).splitlines()[0][:200]}"


@dataclass
class TrainResult:
    models: dict[str, Model]
    status: DataFrame
    predictions: DataFrame | None


def train_all(specs: Sequence[ModelSpec], train: DataFrame, test: DataFrame, label: str) -> TrainResult:
    """Fits the models in turn; a failing one is recorded and skipped.

    Every model reads ``train`` several times: a caller that has not kept it already should.
    """
    models, status, predictions = {}, [], None
    for spec in specs:
        model, state = _attempt(lambda: spec.fit(train, label))
        status.append((spec.name, state))
        if model is None:
            continue
        models[spec.name] = model
        rows = score(model, test, label).withColumn("model", F.lit(spec.name))
        predictions = rows if predictions is None else predictions.unionByName(rows)
    spark = train.sparkSession
    return TrainResult(models, small_table(spark, status, "model string, status string"), predictions)


def train_missing(
    specs: Sequence[ModelSpec], train: DataFrame, test: DataFrame, label: str, root: str, task: str,
) -> TrainResult:
    """Fits and stores what the store lacks; complete models are loaded, not refitted. As with
    ``train_all``, keeping ``train`` is left to the caller."""
    spark = train.sparkSession
    todo = [s for s in specs if not is_complete(spark, root, task, s.name)]
    models, status = {}, []

    def build(spec: ModelSpec) -> Model:
        model = spec.fit(train, label)
        save_model(model, model_path(root, task, spec.name))
        save_predictions(score(model, test, label), root, task, spec.name)
        return model

    for spec in specs:
        if spec in todo:
            model, state = _attempt(lambda: build(spec))
        else:
            model, state = load_model(model_path(root, task, spec.name)), "loaded"
        status.append((spec.name, state))
        if model is not None:
            models[spec.name] = model
    predictions = load_predictions(spark, root, task, list(models)) if models else None
    return TrainResult(models, small_table(spark, status, "model string, status string"), predictions)


def report_predictions(
    predictions: DataFrame, classes: Sequence[str] | None = None, by: Sequence[str] = ("model",),
) -> DataFrame:
    """One report per model from one pass over the stored predictions."""
    if classes is None:
        return classification_report(predictions, by=by)
    return classification_report(predictions, labels=range(len(classes)), names=classes, by=by)


@dataclass
class HierarchicalModel:
    """Joint "tactic - technique" classifier whose predictions roll up to tactics."""

    model: Model
    classes: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Actual and predicted label at both levels, for rows with the two label columns.
        A missing label is the class ``None``, as in fitting."""
        rows = self.model.transform(df)
        predicted = label_at("prediction", self.classes)
        return rows.select(
            KEY,
            label_text(joint_label()).alias("joint"), predicted.alias("predicted_joint"),
            label_text("label_tactic").alias("tactic"), tactic_of(predicted).alias("predicted_tactic"),
        )


def fit_hierarchical(train: DataFrame, **forest) -> HierarchicalModel:
    joint = train.withColumn("label_joint", joint_label())
    classes = classes_of(joint, "label_joint")
    rows = joint.withColumn("joint_idx", index_of("label_joint", classes))
    return HierarchicalModel(fit_rf(rows, "joint_idx", balanced=False, **forest), classes)


def hierarchical_report(predictions: DataFrame) -> DataFrame:
    """Reports at joint and at tactic level, from one pass."""
    levels = predictions.select(F.inline(F.array(
        F.struct(F.lit("joint").alias("level"), F.col("joint").alias("label"), F.col("predicted_joint").alias("prediction")),
        F.struct(F.lit("tactic").alias("level"), F.col("tactic").alias("label"), F.col("predicted_tactic").alias("prediction")),
    )))
    return classification_report(levels, by=["level"])


def fit_balanced_rf(train: DataFrame, label: str, seed: int = 42, min_size: int = 0, **forest) -> Model:
    """Forest fitted on classes cut to equal size; it is judged on the whole test part."""
    return fit_rf(undersample(train, label, seed, min_size=min_size), label, balanced=False, seed=seed, **forest)
