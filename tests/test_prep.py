import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlucid.config import scratch_dir
from flowlucid.operators.prep import (
    build_pipeline, class_weights, encode, feature_names, fit_stats, scaled_columns, with_class_weight,
)

NUM, CAT = ["a", "constant", "empty"], ["p", "q's"]


@pytest.fixture(scope="module")
def train(spark):
    rows = [
        (0, 1.0, 5.0, None, "x", "u"), (1, math.nan, 5.0, None, "x", None), (2, 4.0, 5.0, None, None, "u'v"),
        (3, None, 5.0, None, "b", "u'v"), (4, 7.0, 5.0, None, "b", "u"),
    ]
    return spark.createDataFrame(rows, "uid long, a double, constant double, empty double, p string, `q's` string")


def vectors(df):
    return {r.uid: r.x for r in df.select("uid", vector_to_array("features").alias("x")).collect()}


def test_statistics(train):
    stats = fit_stats(train, NUM, CAT)
    filled = np.array([1.0, 4.0, 4.0, 4.0, 7.0])
    assert stats.mean["a"] == pytest.approx(4.0) and stats.std["a"] == pytest.approx(filled.std())
    assert (stats.mean["empty"], stats.std["empty"], stats.std["constant"]) == (0.0, 0.0, 0.0)
    # Ties go to the smallest value.
    assert stats.mode == {"p": "b", "q's": "u"}
    assert stats.categories == {"p": ["b", "x"], "q's": ["u", "u'v"]}


def test_encoded_vectors_and_names(spark, train):
    stats = fit_stats(train, NUM, CAT)
    prep = build_pipeline(stats)
    assert feature_names(prep) == ["a", "constant", "empty", "p_b", "p_x", "q's_u", "q's_u'v"]
    got = vectors(encode(prep, train))
    std = np.array([1.0, 4.0, 4.0, 4.0, 7.0]).std()
    assert got[0] == pytest.approx([-3 / std, 0, 0, 0, 1, 1, 0])
    assert got[1] == pytest.approx([0, 0, 0, 0, 1, 1, 0])
    assert got[2] == pytest.approx([0, 0, 0, 1, 0, 0, 1])
    unseen = spark.createDataFrame([(9, 4.0, 6.0, 3.0, "new", "u")], train.schema)
    assert vectors(encode(prep, unseen))[9] == pytest.approx([0, 1, 3, 0, 0, 1, 0])
    plain = scaled_columns(train, stats).select("uid", *[f"`{n}`" for n in feature_names(prep)])
    for r in plain.collect():
        assert list(r)[1:] == pytest.approx(got[r.uid])


def test_missing_category_as_its_own(train):
    stats = fit_stats(train, NUM, CAT, null_policy="category")
    assert stats.categories == {"p": ["None", "b", "x"], "q's": ["None", "u", "u'v"]}
    assert vectors(encode(build_pipeline(stats), train))[2][3:6] == pytest.approx([1, 0, 0])


def test_category_column_without_values(spark):
    rows = spark.createDataFrame([(0, 1.0, None), (1, 2.0, None)], "uid long, a double, p string")
    prep = build_pipeline(fit_stats(rows, ["a"], ["p"]))
    assert feature_names(prep) == ["a"]
    assert vectors(encode(prep, rows)) == {0: [-1.0], 1: [1.0]}


def test_stored_pipeline_gives_the_same_vectors(spark, train):
    prep = build_pipeline(fit_stats(train, NUM, CAT))
    path = scratch_dir(spark, "prep")
    prep.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert feature_names(again) == feature_names(prep)
    assert vectors(encode(again, train)) == vectors(encode(prep, train))


def test_class_weights_sum_to_rows(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 90, "a").when(F.col("id") < 99, "b").alias("c"))
    assert class_weights(rows, "c") == pytest.approx({"a": 100 / 270, "b": 100 / 27, "None": 100 / 3})
    assert with_class_weight(rows, "c").agg(F.sum("weight")).first()[0] == pytest.approx(100)
