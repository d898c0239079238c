import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowlucid.config import scratch_dir
from flowlucid.operators.summary import first_n, label_index, nth_row, select_model_columns, shape
from flowlucid.schema import FLOW_SCHEMA
from flowlucid.sources import load_predictions, read_flows, save_predictions, write_weekly_flows
from flowlucid.sources.flows import schema_groups


def test_weekly_directories_round_trip(spark, bench):
    root = scratch_dir(spark, "flows")
    write_weekly_flows(bench.flows, root)
    back = read_flows(spark, f"{root}/week=*")
    assert back.count() == bench.flows.count()
    assert back.drop("week").exceptAll(bench.flows.select(*back.drop("week").columns)).count() == 0
    assert back.filter("week <> date_sub(to_date(ts), dayofweek(ts) - 1)").count() == 0
    assert "PartitionFilters: [isnotnull(week" in plan(back.filter("week = DATE'2024-01-07'"))
    declared = read_flows(spark, f"{root}/week=*", schema=back.drop("week").schema)
    assert declared.exceptAll(back).count() == 0 and declared.count() == back.count()


def test_weeks_of_different_types_and_excluded_directories(spark):
    root = scratch_dir(spark, "mixed")
    spark.sql("SELECT 1L AS uid, 5 AS orig_pkts, 2 AS duration, 'x' AS note").write.parquet(f"{root}/2021-12-12")
    spark.sql("SELECT 2L AS uid, 7L AS orig_pkts, 1.5D AS duration").write.parquet(f"{root}/2022-01-02")
    spark.sql("SELECT 'sum' AS label, 3 AS n").write.parquet(f"{root}/2022_parquet_metrics")
    rows = read_flows(spark, [f"{root}/2021*", f"{root}/2022*"])
    assert {tuple(r) for r in rows.select("uid", "orig_pkts", "duration", "note").collect()} == {
        (1, 5, 2.0, "x"), (2, 7, 1.5, None),
    }
    known = {f.name: f.dataType for f in FLOW_SCHEMA}
    assert all(f.dataType == known[f.name] for f in rows.schema if f.name in known)
    with pytest.raises(FileNotFoundError):
        read_flows(spark, f"{root}/1999*")


def test_files_of_different_types_in_one_directory(spark):
    root = scratch_dir(spark, "mixed_files")
    for week in range(9):
        kind = "int" if week < 5 else "bigint"
        spark.sql(f"SELECT {week}L AS uid, cast({week} AS {kind}) AS orig_pkts").coalesce(1).write.parquet(f"{root}/2022-01-0{week + 1}")
    spark.sql("SELECT 20L AS uid, 1.5D AS orig_pkts, 'new' AS note").coalesce(1).write.mode("append").parquet(f"{root}/2022-01-03")
    spark.sql("SELECT 21L AS uid, 3 AS orig_pkts, 'late' AS note").coalesce(1).write.mode("append").parquet(f"{root}/2022-01-02")
    rows = read_flows(spark, f"{root}/2022*")
    want = {(w, w, None) for w in range(9)} | {(20, 1, "new"), (21, 3, "late")}
    assert {tuple(r) for r in rows.select("uid", "orig_pkts", "note").collect()} == want
    found = schema_groups(spark, spark.read, sorted({f"{root}/2022-01-0{w + 1}" for w in range(9)}))
    assert len(found) == 3 and sum(len(paths) for _, paths in found) == 10


def test_unreadable_footer_is_an_error(spark, tmp_path):
    (tmp_path / "2022").mkdir()
    (tmp_path / "2022" / "a.parquet").write_bytes(b"no table at all")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_flows(spark, f"{tmp_path}/2022")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_projection_and_filter_reach_the_scan(spark):
    root = scratch_dir(spark, "plan")
    spark.range(10).select(
        F.col("id").alias("uid"), F.lit("tcp").alias("proto"), F.lit("none").alias("label_tactic"), F.lit(1).alias("unused"),
    ).write.parquet(f"{root}/2022")
    text = plan(read_flows(spark, f"{root}/2022").filter("label_tactic = 'none'").select("uid"))
    assert "EqualTo(label_tactic,none)" in text
    assert "unused" not in text.split("ReadSchema")[1].splitlines()[0]


def test_prediction_filter_prunes_partitions(spark):
    root = scratch_dir(spark, "pred")
    rows = spark.sql("SELECT 1L AS uid, 0 AS label, 1 AS prediction, array(0.1D, 0.9D) AS probability")
    for model in ("a", "b"):
        save_predictions(rows, root, "binary", model)
    stored = load_predictions(spark, root, "binary", ["a"])
    assert [r.model for r in stored.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(task" in plan(stored)


def test_row_access(bench):
    rows = select_model_columns(bench.flows)
    assert [r.uid for r in first_n(rows, 3).collect()] == [0, 1, 2]
    assert nth_row(rows, 50).first().uid == 50
    assert tuple(shape(rows).first()) == (1000, 13)


def test_label_index_uses_code_point_order(spark):
    rows = spark.createDataFrame([("none",), ("Zeta",), (None,), ("alpha",), ("Éa",)], "c string")
    got = {r.c: r.c_idx for r in label_index(rows, "c").collect()}
    assert got == {None: 0, "Zeta": 1, "alpha": 2, "none": 3, "Éa": 4}
