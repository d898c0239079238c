import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlucid.functions import hash_key
from flowlucid.operators.sampling import (
    class_counts, exact_quantiles, sample_n, stratified_split, top_features, undersample,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds nine tenths of the rows; one class has a single row."""
    cls = F.when(F.col("uid") == 77, "rare").when(F.col("uid") % 10 == 0, "small").otherwise("hot")
    return spark.range(20_000).withColumnRenamed("id", "uid").withColumn("c", cls)


def by_rank(df, share):
    w = Window.partitionBy("c").orderBy(hash_key("uid", 42), "uid")
    n = F.count(F.lit(1)).over(Window.partitionBy("c"))
    return {r.uid for r in df.withColumn("t", F.row_number().over(w) <= F.round(share * n)).filter("t").collect()}


@pytest.mark.parametrize("limits", [{}, {"rank_limit": 50, "digits": 1}, {"rank_limit": 1, "digits": 2}])
def test_split_equals_full_ranking(skewed, limits):
    split = stratified_split(skewed, "c", **limits)
    assert {r.uid for r in split.filter("is_test").collect()} == by_rank(skewed, 0.2)
    assert split.count() == 20_000


def test_split_does_not_depend_on_partitions(skewed):
    picks = [
        {r.uid for r in stratified_split(skewed.repartition(n), "c").filter("is_test").collect()} for n in (1, 7)
    ]
    assert picks[0] == picks[1]


def test_single_row_class_and_whole_classes(skewed):
    one = stratified_split(skewed, "c", test=0.2).filter("c = 'rare'").first()
    assert not one.is_test
    assert stratified_split(skewed, "c", test=1.0).filter("is_test").count() == 20_000
    assert stratified_split(skewed, "c", test=0.0).filter("is_test").count() == 0


def test_missing_label_is_a_class(spark):
    rows = spark.range(100).select(F.col("id").alias("uid"), F.when(F.col("id") < 50, "a").alias("c"))
    got = stratified_split(rows, "c").groupBy("c").agg(F.count_if("is_test").alias("n"), F.count(F.lit(1)).alias("all"))
    assert {(r.c, r.n, r["all"]) for r in got.collect()} == {("a", 10, 50), (None, 10, 50)}


def test_hash_mode_is_close_and_stable(skewed):
    a = stratified_split(skewed, "c", mode="hash").filter("is_test")
    assert abs(a.count() - 4_000) < 200


def test_undersample_sizes(skewed):
    assert class_counts(undersample(skewed, "c"), "c") == {"rare": 1, "small": 1, "hot": 1}
    kept = class_counts(undersample(skewed, "c", min_size=100, rank_limit=100), "c")
    assert kept == {"rare": 1, "small": 2000, "hot": 2000}


def test_sample_n_is_exact(skewed):
    first = {r.uid for r in sample_n(skewed, 1234).collect()}
    again = {r.uid for r in sample_n(skewed.repartition(5), 1234, rank_limit=10, digits=1).collect()}
    assert len(first) == 1234 and first == again
    assert sample_n(skewed, 30_000).count() == 20_000


@pytest.mark.parametrize("limits", [{}, {"limit": 20, "bins": 8}, {"limit": 20, "bins": 8, "accuracy": 3}])
def test_quantiles_are_exact(spark, limits):
    rng = np.random.default_rng(1)
    data = [(float(a), float(b), None) for a, b in zip(rng.pareto(1.0, 3000), rng.integers(0, 3, 3000))]
    df = spark.createDataFrame(data, "skewed double, ties double, empty double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, ["skewed", "ties", "empty"], probs, **limits)
    for i, c in enumerate(["skewed", "ties"]):
        assert np.allclose(got[c], np.quantile([r[i] for r in data], probs), rtol=1e-12, atol=0)
    assert got["empty"] == []


def test_top_features(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", 2.0), (1, "b", 2.0)], "class int, feature string, mean_abs double")
    assert {(r["class"], r.feature) for r in top_features(rows, 1).collect()} == {(0, "b"), (1, "a")}
    assert [r.feature for r in top_features(rows, 1, by=None).collect()] == ["b"]
