"""The published weekly figures are reproduced from rows that have them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlucid.config import scratch_dir
from flowlucid.operators.weekly import sheet_to_long, weekly_bounds, weekly_counts, weekly_sheet
from flowlucid.sources import write_metric_sheet

# The weekly sheet of the binary label. First day of the week, first and
# last record, and rows per label.
WEEKS = [
    ("2021-12-12", "2021-12-17 13:00:45.251239", "2021-12-18 23:59:38.384860", {"False": 20745}),
    ("2021-12-19", "2021-12-19 00:00:08.630389", "2021-12-25 23:59:56.884974", {"False": 97807}),
    ("2021-12-26", "2021-12-26 00:00:27.131120", "2022-01-01 23:59:45.134040", {"False": 98290}),
    ("2022-01-02", "2022-01-02 00:00:15.382572", "2022-01-08 23:59:45.571686", {"False": 133497}),
    ("2022-08-28", "2022-08-31 03:50:37.671000", "2022-09-03 23:36:52.018000", {"Duplicate": 3061, "True": 44166}),
    ("2022-09-04", "2022-09-04 00:06:52.012000", "2022-09-06 16:41:05.179000", {"True": 1762}),
    ("2022-09-11", "2022-09-14 16:25:34.348000", "2022-09-15 21:32:47.365000", {"True": 16871}),
    ("2022-09-18", "2022-09-18 20:48:19.976000", "2022-09-21 21:29:34.746000", {"True": 284004}),
    ("2022-09-25", "2022-09-25 00:54:52.652000", "2022-09-28 16:13:04.157000", {"Duplicate": 1, "True": 65}),
    ("2022-10-02", "2022-10-04 11:40:45.900000", "2022-10-05 18:14:57.059000", {"Duplicate": 1, "True": 4}),
    ("2022-10-09", "2022-10-11 16:25:01.805000", "2022-10-12 18:39:24.330000", {"True": 39}),
    ("2022-10-16", "2022-10-18 16:56:05.859000", "2022-10-20 21:55:17.791000", {"Duplicate": 3, "True": 19}),
    ("2022-10-23", "2022-10-23 22:07:45.793000", "2022-10-23 22:07:45.793000", {"Duplicate": 2, "True": 3}),
]

# Rows per tactic and per technique in each week that has any.
TACTICS = {
    "Collection": {"2022-10-02": 1},
    "Command and Control": {"2022-09-25": 17},
    "Credential Access": {"2022-10-02": 1},
    "Defense Evasion": {"2022-08-28": 3061, "2022-10-16": 2, "2022-10-23": 1},
    "Discovery": {"2022-09-11": 16809, "2022-09-25": 10},
    "Execution": {"2022-09-18": 5, "2022-09-25": 2, "2022-10-02": 3, "2022-10-09": 17, "2022-10-16": 3},
    "Initial Access": {"2022-09-25": 14, "2022-10-16": 5},
    "Lateral Movement": {"2022-09-25": 11},
    "Persistence": {"2022-09-25": 2, "2022-10-16": 6, "2022-10-23": 2},
    "Privilege Escalation": {"2022-08-28": 3061, "2022-10-16": 3, "2022-10-23": 2},
    "Reconnaissance": {"2022-08-28": 41105, "2022-09-04": 1762, "2022-09-11": 62, "2022-09-18": 8553, "2022-09-25": 10},
    "Resource Development": {"2022-09-18": 275446, "2022-10-09": 22, "2022-10-16": 3},
    "none": {"2021-12-12": 20745, "2021-12-19": 97807, "2021-12-26": 98290, "2022-01-02": 133497},
}
TECHNIQUES = {
    "Duplicate": {"2022-08-28": 3061, "2022-09-25": 1, "2022-10-02": 1, "2022-10-16": 3, "2022-10-23": 2},
    "T1046": {"2022-09-11": 16809, "2022-09-25": 10},
    "T1059": {"2022-10-02": 3, "2022-10-16": 2},
    "T1071": {"2022-09-25": 14},
    "T1112": {"2022-10-16": 2, "2022-10-23": 1},
    "T1133": {"2022-09-25": 1},
    "T1136": {"2022-10-16": 3},
    "T1190": {"2022-09-25": 3, "2022-10-16": 5},
    "T1203": {"2022-10-09": 17, "2022-10-16": 1},
    "T1204": {"2022-09-18": 5, "2022-09-25": 2},
    "T1210": {"2022-09-25": 11},
    "T1505": {"2022-09-25": 1},
    "T1546": {"2022-10-23": 1},
    "T1547": {"2022-10-16": 3, "2022-10-23": 1},
    "T1548": {"2022-08-28": 3061},
    "T1557": {"2022-10-02": 1},
    "T1566": {"2022-09-25": 10},
    "T1571": {"2022-09-25": 3},
    "T1587": {"2022-09-18": 275446, "2022-10-09": 22, "2022-10-16": 3},
    "T1589": {"2022-08-28": 264, "2022-09-04": 27, "2022-09-25": 1},
    "T1590": {"2022-08-28": 20364, "2022-09-04": 816, "2022-09-18": 28},
    "T1592": {"2022-08-28": 20477, "2022-09-04": 919, "2022-09-25": 9},
    "T1595": {"2022-09-11": 62, "2022-09-18": 8525},
    "none": {"2021-12-12": 20745, "2021-12-19": 97807, "2021-12-26": 98290, "2022-01-02": 133497},
}


def published_rows(spark, sheet=None):
    """Rows spread evenly between each week's first and last record."""
    table = []
    for week, first, last, labels in WEEKS:
        if sheet:
            labels = {name: weeks[week] for name, weeks in sheet.items() if week in weeks}
        total, offset = sum(labels.values()), 0
        for label, n in sorted(labels.items()):
            table.append((first, last, label, offset, n, total))
            offset += n
    lines = spark.createDataFrame(table, "first string, last string, label_binary string, offset long, n long, total long")
    lo, hi = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("first", "last"))
    at = (F.col("offset") + F.col("i")) / F.greatest(F.col("total") - 1, F.lit(1))
    micros = (lo + F.round((hi - lo) * at)).cast("long")
    return lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "label_binary", F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"),
    )


def test_published_sheet(spark):
    rows = published_rows(spark)
    counts = {(r.label, str(r.week_start)): r.n for r in weekly_counts(rows, "label_binary").collect()}
    assert counts == {(label, week): n for week, _, _, labels in WEEKS for label, n in labels.items()}
    assert sum(counts.values()) == 700_340
    totals = {label: sum(n for (name, _), n in counts.items() if name == label) for label in ("False", "True", "Duplicate")}
    assert totals == {"False": 350_339, "True": 346_933, "Duplicate": 3_068}

    bounds = {str(r.week_start): r for r in weekly_bounds(rows).collect()}
    for week, first, last, labels in WEEKS:
        assert bounds[week]["first"] == dt.datetime.fromisoformat(first)
        assert bounds[week]["last"] == dt.datetime.fromisoformat(last)
        assert str(bounds[week].dt_week_start) == f"{week} 13:00:45.251239"
        assert bounds[week].dt_week_end - bounds[week].dt_week_start == dt.timedelta(days=7)
        assert bounds[week].total == sum(labels.values())


@pytest.mark.parametrize("label, sheet", [("label_tactic", TACTICS), ("label_technique", TECHNIQUES)])
def test_published_tactics_and_techniques(spark, label, sheet):
    rows = published_rows(spark, sheet).withColumnRenamed("label_binary", label)
    counts = {(r.label, str(r.week_start)): r.n for r in weekly_counts(rows, label).collect()}
    assert counts == {(name, week): n for name, weeks in sheet.items() for week, n in weeks.items()}
    assert sum(counts.values()) == 700_340
    wide = weekly_sheet(rows, label)
    lines = {r[0]: r for r in wide.collect()}
    assert list(lines) == sorted([*sheet, "dt_first_record", "dt_last_record", "dt_week_end", "dt_week_start", "total_record_count"])
    for name, weeks in sheet.items():
        for (week, first, last, labels), title, cell in zip(WEEKS, wide.columns[1:], lines[name][1:], strict=True):
            assert title.startswith(week) and cell == (str(weeks[week]) if week in weeks else None)
    for i, (_, first, last, labels) in enumerate(WEEKS, 1):
        assert lines["dt_first_record"][i] == first and lines["dt_last_record"][i] == last
        assert lines["total_record_count"][i] == str(sum(labels.values()))


def test_sheet_layout_and_csv(spark):
    rows = published_rows(spark)
    sheet = weekly_sheet(rows, "label_binary")
    assert sheet.columns[0] == "label_binary" and len(sheet.columns) == 14
    assert sheet.columns[1] == "2021-12-12 - 2021-12-19" and sheet.columns[5] == "2022-08-28 - 2022-09-04"
    lines = {r[0]: r for r in sheet.collect()}
    assert list(lines) == [
        "Duplicate", "False", "True", "dt_first_record", "dt_last_record", "dt_week_end", "dt_week_start",
        "total_record_count",
    ]
    assert lines["Duplicate"][1] is None and lines["Duplicate"][5] == "3061"
    assert lines["dt_first_record"][2] == "2021-12-19 00:00:08.630389"
    assert lines["dt_last_record"][1] == "2021-12-18 23:59:38.384860"
    assert lines["dt_week_end"][13] == "2022-10-30 13:00:45.251239"

    path = scratch_dir(spark, "sheet")
    write_metric_sheet(sheet, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == sheet.columns
    assert sorted(sheet_to_long(back).collect()) == sorted(sheet_to_long(sheet).collect())
