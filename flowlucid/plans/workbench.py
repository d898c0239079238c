"""The shared stages of the registered queries: flows, split, encoded rows, fitted models.

Each stage is built on first use and kept per session and data folder, so one split, one
encoded table and one fit serve all queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import spread
from ..explain.tree import TreePaths, tree_paths
from ..functions import encode_binary, with_flow_features
from ..operators.models import (
    HierarchicalModel, fit_balanced_rf, fit_dt, fit_gnb, fit_hierarchical, fit_lr, fit_rf,
)
from ..operators.prep import FeatureStats, build_pipeline, encode, feature_names, fit_stats
from ..operators.sampling import stratified_split
from ..operators.summary import classes_of, index_of
from .fixture import flows

# A label that is a function of the features, so that models and explanations of it are
# known in closed form.
RULE = "conn_state = 'SF' AND proto <> 'icmp'"
# The rule, with one row in a hundred told wrong: nearly all that can be learned follows from the
# features, as in real flows.
SIGNAL = f"({RULE}) <> (uid * 7919 % 100 = 0)"
# Labels of two levels that are functions of the features, too.
LEVELS = {
    "label_tactic": "case when conn_state = 'SF' then 'open' else 'other' end",
    "label_technique": "case when proto = 'icmp' then 'T1' else 'T2' end",
}


class Workbench:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._models: dict[str, Model] = {}
        self._paths: dict[str, TreePaths] = {}

    @cached_property
    def flows(self) -> DataFrame:
        return flows(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        """Flows with derived features and the binary label ``y``."""
        rows = with_flow_features(self.flows)
        return rows.withColumn("y", encode_binary(rows))

    @cached_property
    def split(self) -> DataFrame:
        return stratified_split(self.features, "y")

    @property
    def train(self) -> DataFrame:
        return self.split.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.split.filter("is_test")

    @cached_property
    def tactics(self) -> list[str]:
        return classes_of(self.flows, "label_tactic")

    @cached_property
    def stats(self) -> FeatureStats:
        return fit_stats(self.train)

    @cached_property
    def prep(self) -> PipelineModel:
        return build_pipeline(self.stats)

    @cached_property
    def names(self) -> list[str]:
        return feature_names(self.prep)

    @cached_property
    def encoded(self) -> DataFrame:
        """Encoded rows, kept because every fit and explanation iterates over them."""
        rows = encode(self.prep, self.split).select(
            "uid", "y", index_of("label_tactic", self.tactics).alias("tactic_idx"),
            "label_tactic", "label_technique", "is_test", F.expr(RULE).cast("int").alias("rule"),
            F.expr(SIGNAL).cast("int").alias("signal"), "features",
            *[F.expr(text).alias(f"{name}_level") for name, text in LEVELS.items()],
        )
        return spread(rows, "uid").persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def x_train(self) -> DataFrame:
        return self.encoded.filter(~F.col("is_test"))

    @property
    def x_test(self) -> DataFrame:
        return self.encoded.filter("is_test")

    @cached_property
    def two_levels(self) -> DataFrame:
        """The encoded rows with labels of two levels that are functions of the features.

        A row has the labels of each row with its uid: its own where uids are unique, so that
        nothing is joined or kept twice.
        """
        rows, kinds = self.encoded.drop(*LEVELS), {f"{name}_level": name for name in LEVELS}
        if rows.filter("uid is not null").groupBy("uid").count().filter("count > 1").isEmpty():
            return rows.filter("uid is not null").withColumnsRenamed(kinds)
        labels = rows.select("uid", *kinds).withColumnsRenamed(kinds)
        return rows.drop(*kinds).join(labels, "uid").persist(StorageLevel.MEMORY_AND_DISK)

    def model(self, name: str) -> Model | HierarchicalModel:
        fits = {
            "rf_binary": lambda: fit_rf(self.x_train, "y"),
            "rf_tactic": lambda: fit_rf(self.x_train, "tactic_idx"),
            "dt_binary": lambda: fit_dt(self.x_train, "y"),
            "dt_tactic": lambda: fit_dt(self.x_train, "tactic_idx"),
            "lr_binary": lambda: fit_lr(self.x_train, "y"),
            "lr_tactic": lambda: fit_lr(self.x_train, "tactic_idx", family="multinomial"),
            "gnb_binary": lambda: fit_gnb(self.x_train, "y"),
            "gnb_tactic": lambda: fit_gnb(self.x_train, "tactic_idx"),
            "rf_rule": lambda: fit_rf(self.x_train, "rule"),
            "dt_rule": lambda: fit_dt(self.x_train, "rule"),
            "lr_rule": lambda: fit_lr(self.x_train, "rule"),
            "stump_rule": lambda: fit_dt(self.x_train, "rule", maxDepth=1),
            "rf_signal": lambda: fit_rf(self.x_train, "signal"),
            "dt_signal": lambda: fit_dt(self.x_train, "signal"),
            "lr_signal": lambda: fit_lr(self.x_train, "signal"),
            "gnb_signal": lambda: fit_gnb(self.x_train, "signal"),
            "hierarchical": lambda: fit_hierarchical(self.x_train),
            "balanced_rf": lambda: fit_balanced_rf(self.x_train, "tactic_idx"),
        }
        if name not in self._models:
            self._models[name] = fits[name]()
        return self._models[name]

    def paths(self, name: str) -> TreePaths:
        if name not in self._paths:
            self._paths[name] = tree_paths(self.spark, self.model(name))
        return self._paths[name]


_open: dict[tuple[str, str], Workbench] = {}


def workbench(spark: SparkSession, sf_dir: str) -> Workbench:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _open:
        _open[key] = Workbench(spark, str(sf_dir))
    return _open[key]
