"""The registered queries as plain SQL for an independent engine.

Written from the definitions, not from the Spark plans: imputation, scaling, ranking and
Gaussian naive Bayes are spelt out over the whole tables.
"""

from __future__ import annotations

from datetime import date, timedelta

from .fixture import FLOW_EXPRESSIONS

# Fixed values of the fixture: numeric columns and the categories of each one-hot column.
NUMERIC = [
    "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "duration", "pktAtsec", "BitRate", "interTime", "avgLenPkt",
]
CATEGORIES = {
    "proto": ["icmp", "tcp", "udp"],
    "service": ["dns", "http", "ssl"],
    "conn_state": ["OTH", "REJ", "RSTO", "S0", "SF"],
}
TACTICS = ["Discovery", "Reconnaissance", "Resource Development", "none"]
ONE_HOT = [f"{c}_{v}" for c, values in CATEGORIES.items() for v in values]
VECTOR = NUMERIC + ONE_HOT
PDP_FEATURES = ["orig_pkts", "resp_pkts", "pktAtsec", "avgLenPkt"]
MODEL_COLUMNS = (
    "orig_pkts, resp_pkts, orig_bytes, resp_bytes, duration, proto, service, conn_state, history,"
    " label_binary, label_tactic, label_technique"
)

FLOWS = "flows AS (SELECT " + ", ".join(f"{text} AS {name}" for name, text in FLOW_EXPRESSIONS.items()) + " FROM events)"
FEATURES = FLOWS + """,
feats AS (
  SELECT *,
    orig_pkts / (CASE WHEN duration = 0 THEN 1 ELSE duration END) AS pktAtsec,
    (orig_bytes + resp_bytes) * 8 / (CASE WHEN duration = 0 THEN 1 ELSE duration END) AS BitRate,
    duration / (CASE WHEN orig_pkts = 0 THEN 1 ELSE orig_pkts END) AS interTime,
    orig_bytes / (CASE WHEN orig_pkts = 0 THEN 1 ELSE orig_pkts END) AS avgLenPkt,
    orig_pkts + resp_pkts AS numPKT,
    orig_bytes + resp_bytes AS numBytes,
    CASE label_binary WHEN 'False' THEN 0 ELSE 1 END AS y,
    CASE label_tactic """ + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TACTICS)) + """ END AS tactic_idx
  FROM flows)"""
SPLIT = FEATURES + """,
split AS (
  SELECT *,
    row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', cast(uid AS varchar))), uid)
      <= round(0.2 * count(*) OVER (PARTITION BY y)) AS is_test
  FROM feats),
train AS (SELECT * FROM split WHERE NOT is_test),
test AS (SELECT * FROM split WHERE is_test)"""
MEANS = SPLIT + ",\nmeans AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in NUMERIC) + " FROM train)"
MODES = (
    SPLIT + ",\n" + ",\n".join(
        f"mode_{c} AS (SELECT {c} AS v FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in CATEGORIES
    )
)
ENCODED = (
    MEANS + MODES.removeprefix(SPLIT)
    + ",\nfilled AS (SELECT uid, y, tactic_idx, is_test, "
    + ", ".join(f"coalesce(s.{c}, (SELECT {c} FROM means)) AS {c}" for c in NUMERIC) + ", "
    + ", ".join(f"coalesce(s.{c}, (SELECT v FROM mode_{c})) AS {c}" for c in CATEGORIES)
    + " FROM split s)"
    + ",\nspreads AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + " FROM filled WHERE NOT is_test)"
    + ",\nx AS (SELECT uid, y, tactic_idx, is_test, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in NUMERIC) + ", "
    + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1.0::double ELSE 0.0::double END AS {c}_{v}" for c, vs in CATEGORIES.items() for v in vs
    )
    + " FROM filled, spreads)"
)


def _gnb(label: str) -> str:
    """CTE ``pred(uid, label, prediction, lj per class)`` of Gaussian naive Bayes on the encoded rows."""
    profile = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in VECTOR)
    largest = "greatest(" + ", ".join(f"var_pop({f})" for f in VECTOR) + ")"
    density = " + ".join(f"ln(2 * pi() * (v_{f} + eps)) + ({f} - m_{f}) ^ 2 / (v_{f} + eps)" for f in VECTOR)
    return ENCODED + f""",
profile AS (SELECT {label} AS cls, count(*) AS n_cls, {profile} FROM x WHERE NOT is_test GROUP BY {label}),
overall AS (SELECT count(*) AS n_all, 1e-9 * {largest} AS eps FROM x WHERE NOT is_test),
joint AS (
  SELECT uid, {label} AS label, cls, ln(n_cls / n_all) - 0.5 * ({density}) AS lj
  FROM (SELECT * FROM x WHERE is_test), profile, overall),
pred AS (
  SELECT uid, label, cls AS prediction FROM joint
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY lj DESC, cls) = 1)"""


GNB_BINARY = _gnb("y")
GNB_TACTIC = _gnb("tactic_idx")


def _report(predictions: str, classes: str, extra: str = "") -> str:
    """Classification report over ``pred``; ``classes`` is a relation (c, name)."""
    return predictions + f""",
classes AS ({classes}),
per_class AS (
  SELECT c, name,
    (SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS tp,
    (SELECT count(*) FROM pred WHERE prediction = c) AS predicted_n,
    (SELECT count(*) FROM pred WHERE label = c) AS support
  FROM classes),
scored AS (
  SELECT name, support, tp,
    CASE WHEN predicted_n = 0 THEN 0 ELSE tp / predicted_n END AS p,
    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r,
    CASE WHEN predicted_n + support = 0 THEN 0 ELSE 2 * tp / (predicted_n + support) END AS f
  FROM per_class)
SELECT 'class' AS kind, name AS "class", round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  cast(support AS bigint) AS support FROM scored
UNION ALL
SELECT 'summary', 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), cast(sum(support) AS bigint) FROM scored
UNION ALL
SELECT 'summary', 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), cast(sum(support) AS bigint) FROM scored
UNION ALL
SELECT 'summary', 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), cast(sum(support) AS bigint) FROM scored"""


BINARY_REPORT = _report(GNB_BINARY, "SELECT DISTINCT label AS c, cast(label AS varchar) AS name FROM pred"
                        " UNION SELECT DISTINCT prediction, cast(prediction AS varchar) FROM pred")
TACTIC_REPORT = _report(GNB_TACTIC, "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t}')" for i, t in enumerate([*TACTICS, "Collection"])) + ") v(c, name)")

WEEK = "cast(ts AS date) - cast(dayofweek(ts) AS int)"
BOUNDS = FLOWS + f""",
weeks AS (SELECT {WEEK} AS week_start, min(ts) AS first, max(ts) AS last, count(*) AS total FROM flows GROUP BY 1),
origin AS (SELECT min(ts) - date_trunc('day', min(ts)) AS tod FROM flows),
bounds AS (
  SELECT week_start, first, last, week_start + tod AS dt_week_start,
    week_start + tod + INTERVAL 7 DAY AS dt_week_end, total
  FROM weeks, origin)"""


def _sheet(label: str) -> str:
    stamp = "'%Y-%m-%d %H:%M:%S.%f'"
    title = "concat(cast({0} AS varchar), ' - ', cast({0} + 7 AS varchar))".format("week_start")
    stats = {
        "dt_first_record": f"strftime(first, {stamp})", "dt_last_record": f"strftime(last, {stamp})",
        "dt_week_end": f"strftime(dt_week_end, {stamp})", "dt_week_start": f"strftime(dt_week_start, {stamp})",
        "total_record_count": "cast(total AS varchar)",
    }
    lines = [f"SELECT '{name}' AS name, {title} AS week, {cell} AS cell FROM bounds" for name, cell in stats.items()]
    lines.append(
        f"SELECT {label} AS name, {title} AS week, cast(count(*) AS varchar) AS cell"
        f" FROM (SELECT *, {WEEK} AS week_start FROM flows) GROUP BY {label}, week_start"
    )
    return f"WITH {BOUNDS}\n" + "\nUNION ALL\n".join(lines)


def _melt(source: str, where: str, columns: list[str], keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS feature, {c} AS v FROM {source} {where}" for c in columns
    )


ATTRIBUTION_MEANS = (
    f"attributions AS ({_melt('x', 'WHERE is_test', VECTOR, 'y AS cls')}),\n"
    "summary AS (SELECT cls AS \"class\", feature, avg(abs(v)) AS mean_abs FROM attributions GROUP BY cls, feature)"
)

GRID = ENCODED + ",\nmelted AS (" + _melt("x", "WHERE is_test", PDP_FEATURES, "uid") + """),
ends AS (
  SELECT feature, count(DISTINCT v) AS n_distinct, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi
  FROM melted GROUP BY feature),
few AS (SELECT DISTINCT m.feature, v FROM melted m JOIN ends e ON m.feature = e.feature WHERE n_distinct < 100),
grid AS (
  SELECT feature, cast(row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS int) AS position, v AS grid_value FROM few
  UNION ALL
  SELECT feature, cast(i AS int), lo + (hi - lo) * i / 99 FROM ends, range(100) t(i) WHERE n_distinct >= 100)"""


def _pdp_nb() -> str:
    """Mean probability of class 1 with one feature replaced, for every test row and grid point."""
    profile = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in VECTOR)
    largest = "greatest(" + ", ".join(f"var_pop({f})" for f in VECTOR) + ")"
    curves = []
    for target in PDP_FEATURES:
        density = " + ".join(
            f"ln(2 * pi() * (v_{f} + eps)) + ({'grid_value' if f == target else f} - m_{f}) ^ 2 / (v_{f} + eps)"
            for f in VECTOR
        )
        curves.append(f"""
  SELECT g.feature, g.position, uid, cls, ln(n_cls / n_all) - 0.5 * ({density}) AS lj
  FROM (SELECT * FROM x WHERE is_test), (SELECT * FROM grid WHERE feature = '{target}') g, profile, overall""")
    return GRID + f""",
profile AS (SELECT y AS cls, count(*) AS n_cls, {profile} FROM x WHERE NOT is_test GROUP BY y),
overall AS (SELECT count(*) AS n_all, 1e-9 * {largest} AS eps FROM x WHERE NOT is_test),
joint AS ({' UNION ALL '.join(curves)}),
prob AS (
  SELECT feature, position, uid,
    1 / (1 + exp(max(CASE WHEN cls = 0 THEN lj END) - max(CASE WHEN cls = 1 THEN lj END))) AS p
  FROM joint GROUP BY feature, position, uid)
SELECT feature, position, round(avg(p), 6) AS avg_probability FROM prob GROUP BY feature, position"""


# A tree that learns "conn_state is SF and proto is not icmp" splits on the state first: its
# value is known for every set of known features, and so are Shapley and interaction values.
RULE = SPLIT + """,
flags AS (
  SELECT uid, is_test, CASE WHEN conn_state = 'SF' THEN 1 ELSE 0 END AS a, CASE WHEN proto <> 'icmp' THEN 1 ELSE 0 END AS b
  FROM split),
shares AS (SELECT avg(a) AS pa, avg(b) FILTER (a = 1) AS pb FROM flags WHERE NOT is_test),
games AS (
  SELECT uid, a * b AS rule, pa * pb AS v0, a * pb AS va, b * pa AS vb, a * b AS vab FROM flags, shares WHERE is_test),
values_of AS (
  SELECT uid, rule, 0.5 * (va - v0 + vab - vb) AS phi_a, 0.5 * (vb - v0 + vab - va) AS phi_b,
    0.5 * (vab - va - vb + v0) AS pair FROM games)"""


def _rule_attributions() -> str:
    known = {"conn_state_SF": "phi_a", "proto_icmp": "phi_b"}
    return f"WITH {RULE}\n" + " UNION ALL ".join(
        f"SELECT uid, '{f}' AS feature, round({known.get(f, '0.0::double')}, 9) + 0.0 AS value FROM values_of" for f in VECTOR
    )


def _rule_kernel() -> str:
    """The rule against 100 train rows, the first in hash order: a game of two features."""
    known = {"conn_state_SF": "0.5 * (va - v0 + vab - vb)", "proto_icmp": "0.5 * (vb - v0 + vab - va)"}
    return f"""WITH {RULE},
points AS (SELECT a, b FROM flags WHERE NOT is_test ORDER BY md5(concat('42:', cast(uid AS varchar))), uid LIMIT 100),
means AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * b) AS mab FROM points),
played AS (SELECT uid, mab AS v0, a * mb AS va, b * ma AS vb, a * b AS vab FROM flags, means WHERE is_test)
""" + " UNION ALL ".join(
        f"SELECT uid, '{f}' AS feature, round({known.get(f, '0.0::double')}, 6) + 0.0 AS value FROM played" for f in VECTOR
    )


def _rule_importance() -> str:
    gain = {"conn_state_SF": "root - second", "proto_icmp": "second"}
    return f"""WITH {RULE},
gini AS (SELECT 2 * pa * pb * (1 - pa * pb) AS root, pa * 2 * pb * (1 - pb) AS second FROM shares)
""" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(({gain.get(f, '0')}) / root, 6) AS importance FROM gini" for f in VECTOR
    )


def _discretizer() -> str:
    melted = _melt("train", "", NUMERIC, "uid")
    return f"""WITH {SPLIT},
melted AS (SELECT uid, feature, cast(v AS double) AS v FROM ({melted}) WHERE v IS NOT NULL),
edges AS (
  SELECT DISTINCT feature, unnest([quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]) AS edge
  FROM melted GROUP BY feature),
binned AS (
  SELECT m.uid, m.feature, m.v, cast(sum(CASE WHEN v > edge THEN 1 ELSE 0 END) AS int) AS bin
  FROM melted m JOIN edges e ON m.feature = e.feature GROUP BY m.uid, m.feature, m.v)
SELECT feature, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS share,
  round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
FROM binned GROUP BY feature, bin"""


def _lime_moments() -> str:
    """Lines drawn for one row by digests, and the weighted sums of products of their columns."""
    slots = " UNION ALL ".join(f"SELECT uid, is_test, {i} AS slot, {c} AS v FROM x" for i, c in enumerate(VECTOR))
    m, state, proto = len(VECTOR), VECTOR.index("conn_state_SF"), VECTOR.index("proto_icmp")
    return f"""WITH {ENCODED},
cells AS ({slots}),
edges AS (
  SELECT DISTINCT slot, unnest([quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]) AS edge
  FROM cells WHERE NOT is_test GROUP BY slot),
binned AS (
  SELECT c.uid, c.is_test, c.slot, c.v, sum(CASE WHEN v > edge THEN 1 ELSE 0 END) AS bin
  FROM cells c JOIN edges e ON c.slot = e.slot GROUP BY c.uid, c.is_test, c.slot, c.v),
shares AS (SELECT slot, bin, count(*) AS n, avg(v) AS mean FROM binned WHERE NOT is_test GROUP BY slot, bin),
bins AS (
  SELECT slot, bin, mean, sum(n) OVER (PARTITION BY slot ORDER BY bin) / sum(n) OVER (PARTITION BY slot) AS upto FROM shares),
chosen AS (SELECT uid FROM x WHERE is_test ORDER BY uid LIMIT 1 OFFSET 50),
own AS (SELECT uid, slot, bin, v FROM binned JOIN chosen USING (uid)),
lines AS (SELECT unnest(range(1, 5000)) AS line),
draws AS (
  SELECT line, slot, bin AS own_bin,
    cast('0x' || substr(md5(concat('42:', cast(uid AS varchar), ':', cast(line AS varchar), ':', cast(slot AS varchar))), 1, 8) AS ubigint) / 4294967296.0::double AS u
  FROM own, lines),
picks AS (
  SELECT line, d.slot, own_bin, coalesce(min(b.bin) FILTER (u < upto), max(b.bin)) AS bin
  FROM draws d JOIN bins b ON d.slot = b.slot GROUP BY line, d.slot, own_bin),
drawn AS (
  SELECT line, p.slot, CASE WHEN p.bin = own_bin THEN 1 ELSE 0 END AS same, mean FROM picks p JOIN bins b ON p.slot = b.slot AND p.bin = b.bin
  UNION ALL SELECT 0, slot, 1, v FROM own),
weights AS (
  SELECT line, sqrt(exp(-sum(1 - same) / (0.5625 * {m}))) AS w,
    CASE WHEN max(mean) FILTER (slot = {state}) > 0.5 AND max(mean) FILTER (slot = {proto}) <= 0.5 THEN 1 ELSE 0 END AS y
  FROM drawn GROUP BY line),
columns_of AS (
  SELECT line, 0 AS c, 1 AS v FROM weights UNION ALL SELECT line, slot + 1, same FROM drawn UNION ALL SELECT line, {m + 1}, y FROM weights)
SELECT (SELECT uid FROM chosen) AS uid, a.c AS i, b.c AS j, round(sum(w * a.v * b.v), 6) + 0.0 AS total
FROM columns_of a JOIN columns_of b ON a.line = b.line AND a.c <= b.c JOIN weights w ON w.line = a.line GROUP BY a.c, b.c"""


def _perfect(name: str, label: str, source: str) -> str:
    """The report of predictions that are all right."""
    columns = f"SELECT {name}"
    return f"""{columns}'class' AS kind, {label} AS "class", 1.0::double AS "precision", 1.0::double AS recall, 1.0::double AS f1, count(*) AS support FROM {source} GROUP BY {label}
UNION ALL {columns}'summary', unnest(['macro avg', 'weighted avg']), 1.0, 1.0, 1.0, (SELECT count(*) FROM {source})
UNION ALL {columns}'summary', 'accuracy', NULL, NULL, 1.0, (SELECT count(*) FROM {source})"""


def _split_gains() -> str:
    """Impurity before and after for every slot."""
    def side(where: str) -> str:
        return f"sum(w) FILTER ({where}) - (sum(w * r) FILTER ({where}) ^ 2 + sum(w * (1 - r)) FILTER ({where}) ^ 2) / sum(w) FILTER ({where})"

    parts = " UNION ALL ".join(f"SELECT {i} AS slot, rule AS r, 1.0::double AS w, {c} > {0.05 if c in NUMERIC else 0.5} AS up FROM x JOIN rules USING (uid) WHERE NOT is_test" for i, c in enumerate(VECTOR))
    return f"""WITH {ENCODED},
rules AS (SELECT uid, CASE WHEN conn_state = 'SF' AND proto <> 'icmp' THEN 1 ELSE 0 END AS rule FROM split),
cells AS ({parts})
SELECT slot, round(({side('true')} - ({side('up')}) - ({side('NOT up')})) / sum(w), 9) AS gain FROM cells GROUP BY slot"""


WEIGHTED = """sizes AS (SELECT y, count(*) AS n FROM train GROUP BY y),
weighted AS (SELECT s.*, (SELECT sum(n) FROM sizes) / (2 * n) AS w FROM train s JOIN sizes USING (y))"""


def _weeks() -> str:
    """A column for each of the five weeks the fixture's events lie in."""
    first = date(2023, 12, 31)
    titles = [f"{first + timedelta(7 * i)} - {first + timedelta(7 * i + 7)}" for i in range(5)]
    return ", ".join(f"max(cell) FILTER (week = '{t}') AS \"{t}\"" for t in titles)


def sql() -> dict[str, str]:
    vector_rows = " UNION ALL ".join(f"SELECT y, {i} AS slot, {f} AS v FROM x" for i, f in enumerate(VECTOR))
    return {
        "flow_profile": f"""WITH {FEATURES}
SELECT y, count(*) AS n, {', '.join(f'round(avg({c}), 4) AS avg_{c}' for c in ('pktAtsec', 'BitRate', 'interTime', 'avgLenPkt'))}
FROM feats GROUP BY y""",
        "scan_flows": f"""WITH {FLOWS}
SELECT label_tactic, proto, count(*) AS n, cast(sum(orig_bytes) AS bigint) AS orig_bytes, min(ts) AS first_ts
FROM flows GROUP BY label_tactic, proto""",
        "register_view": f"""WITH {FLOWS}
SELECT proto, service, count(*) AS n, cast(sum(orig_pkts) AS bigint) AS pkts FROM flows GROUP BY proto, service""",
        "write_predictions": f"WITH {GNB_BINARY} SELECT uid, 'binary' AS task, 'gnb_binary' AS model, label, prediction FROM pred",
        "read_predictions": f"""WITH {GNB_BINARY}
SELECT 'gnb_binary' AS model, label, prediction, count(*) AS n FROM pred GROUP BY label, prediction""",
        "save_model": f"WITH {GNB_BINARY} SELECT uid, label, prediction FROM pred",
        "load_model": f"WITH {GNB_TACTIC} SELECT uid, label, prediction FROM pred",
        "save_report": f"WITH {BINARY_REPORT}",
        "metrics_csv": _sheet("label_tactic"),
        "project_flows": f"WITH {FLOWS} SELECT uid, {MODEL_COLUMNS} FROM flows",
        "filter_tactics": f"""WITH {FLOWS}
SELECT uid, label_tactic, proto FROM flows WHERE label_tactic IN ('Discovery', 'Reconnaissance')""",
        "safe_div": f"""WITH {FLOWS}
SELECT uid, resp_bytes / (CASE WHEN duration = 0 THEN 1 ELSE duration END) AS ratio FROM flows""",
        "feat_pkt_rate": f"WITH {FEATURES} SELECT uid, pktAtsec FROM feats",
        "feat_bit_rate": f"WITH {FEATURES} SELECT uid, BitRate FROM feats",
        "feat_inter_time": f"WITH {FEATURES} SELECT uid, interTime FROM feats",
        "feat_avg_len": f"WITH {FEATURES} SELECT uid, avgLenPkt FROM feats",
        "feat_totals": f"WITH {FEATURES} SELECT uid, numPKT, numBytes FROM feats",
        "label_binary": f"""WITH {FLOWS}
SELECT uid, label_binary, CASE WHEN label_binary IN ('True', 'Duplicate') THEN 1 ELSE 0 END AS y FROM flows""",
        "label_joint": f"WITH {FLOWS} SELECT uid, label_tactic || ' - ' || label_technique AS label_joint FROM flows",
        "head_rows": f"WITH {SPLIT} SELECT uid, {MODEL_COLUMNS} FROM test ORDER BY uid LIMIT 100",
        "row_pick": f"WITH {SPLIT} SELECT uid, {MODEL_COLUMNS} FROM test ORDER BY uid LIMIT 1 OFFSET 50",
        "shape": f"WITH {FLOWS} SELECT count(*) AS n_rows, 12 AS n_cols FROM flows",
        "count_by_label": f"WITH {FLOWS} SELECT label_binary, count(*) AS n FROM flows GROUP BY label_binary",
        "class_support": f"""WITH {SPLIT},
classes AS (SELECT DISTINCT label_tactic AS c FROM flows UNION SELECT 'Collection')
SELECT c AS "class", (SELECT count(*) FROM train WHERE label_tactic = c) AS n_train,
  (SELECT count(*) FROM test WHERE label_tactic = c) AS n_test FROM classes""",
        "distinct_labels": f"""WITH {GNB_TACTIC}
SELECT DISTINCT 'train' AS side, tactic_idx AS c FROM train
UNION ALL SELECT DISTINCT 'test', tactic_idx FROM test
UNION ALL SELECT DISTINCT 'predicted', prediction FROM pred""",
        "confusion_matrix": f"""WITH {GNB_TACTIC}
SELECT label AS actual, prediction AS predicted, count(*) AS n FROM pred GROUP BY label, prediction""",
        "confusion_matrix_wide": f"""WITH {GNB_BINARY}
SELECT label AS actual, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
FROM pred GROUP BY label""",
        "class_report": f"WITH {BINARY_REPORT}",
        "class_report_tactic": f"WITH {TACTIC_REPORT}",
        "class_report_partial": f"""WITH {GNB_TACTIC},
classes AS (SELECT * FROM (VALUES (0, '{TACTICS[0]}'), (1, '{TACTICS[1]}')) v(c, name)),
n AS (
  SELECT name, (SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS tp,
    (SELECT count(*) FROM pred WHERE prediction = c) AS pn, (SELECT count(*) FROM pred WHERE label = c) AS an FROM classes),
s AS (
  SELECT name, an, CASE WHEN pn = 0 THEN 0 ELSE tp / pn END AS p, CASE WHEN an = 0 THEN 0 ELSE tp / an END AS r,
    CASE WHEN pn + an = 0 THEN 0 ELSE 2 * tp / (pn + an) END AS f FROM n)
SELECT 'class' AS kind, name AS "class", round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, an AS support FROM s
UNION ALL SELECT 'summary', 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(an) FROM s
UNION ALL SELECT 'summary', 'weighted avg', round(sum(p * an) / sum(an), 6), round(sum(r * an) / sum(an), 6), round(sum(f * an) / sum(an), 6), sum(an) FROM s
UNION ALL SELECT 'summary', 'accuracy', NULL, NULL, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6), count(*) FROM pred""",
        "class_report_empty": f"""WITH {FLOWS}, t AS (SELECT DISTINCT label_tactic AS name FROM flows)
SELECT 'class' AS kind, name AS "class", 0.0::double AS "precision", 0.0::double AS recall, 0.0::double AS f1, 0::bigint AS support FROM t
UNION ALL SELECT 'summary', unnest(['macro avg', 'weighted avg']), 0.0, 0.0, 0.0, 0
UNION ALL SELECT 'summary', 'accuracy', NULL, NULL, 0.0, 0""",
        "shap_points": f"""WITH {ENCODED}
SELECT uid, cls AS "class", feature, round(v, 6) + 0.0 AS value, round(v, 6) + 0.0 AS feature_value
FROM ({_melt('x', 'WHERE is_test', VECTOR, 'uid, y AS cls')})""",
        "weekly_counts": f"""WITH {FLOWS}
SELECT label_technique AS label, cast({WEEK} AS varchar) AS week_start, count(*) AS n FROM flows GROUP BY 1, 2""",
        "weekly_bounds": f"WITH {BOUNDS} SELECT * REPLACE (cast(week_start AS varchar) AS week_start) FROM bounds",
        "weekly_sheet_long": _sheet("label_technique"),
        "weekly_sheet": f"SELECT name AS label_binary, {_weeks()} FROM ({_sheet('label_binary')}) GROUP BY name",
        "class_profile": f"""WITH {SPLIT}
SELECT y, feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, count(v) AS n
FROM ({_melt('train', '', NUMERIC, 'y')}) GROUP BY y, feature""",
        "label_encode": f"""WITH {FLOWS},
classes AS (SELECT label_tactic, row_number() OVER (ORDER BY label_tactic) - 1 AS i FROM (SELECT DISTINCT label_tactic FROM flows))
SELECT uid, label_tactic, cast(i AS int) AS tactic_idx FROM flows JOIN classes USING (label_tactic)""",
        "split_stratified": f"WITH {SPLIT} SELECT uid, y, is_test FROM split",
        "undersample": f"""WITH {SPLIT},
ranked AS (
  SELECT uid, label_tactic,
    row_number() OVER (PARTITION BY label_tactic ORDER BY md5(concat('42:', cast(uid AS varchar))), uid) AS r FROM train)
SELECT uid, label_tactic FROM ranked
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM train GROUP BY label_tactic))""",
        "sample_rows": f"""WITH {SPLIT}
SELECT uid, y FROM test ORDER BY md5(concat('42:', cast(uid AS varchar))), uid LIMIT 1000""",
        "topk_features": f"""WITH {ENCODED},
{ATTRIBUTION_MEANS}
SELECT "class", feature, cast(r AS int) AS rank, round(mean_abs, 6) AS mean_abs
FROM (SELECT *, row_number() OVER (PARTITION BY "class" ORDER BY mean_abs DESC, feature) AS r FROM summary) WHERE r <= 10""",
        "impute_mean": f"WITH {MEANS} SELECT uid, " + ", ".join(
            f"cast(coalesce(s.{c}, (SELECT round({c}, 6) FROM means)) AS double) AS {c}" for c in NUMERIC) + " FROM split s",
        "impute_mode": f"WITH {MODES} SELECT uid, " + ", ".join(
            f"coalesce(s.{c}, (SELECT v FROM mode_{c})) AS {c}" for c in CATEGORIES) + " FROM split s",
        "standardize": f"WITH {ENCODED} SELECT uid, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in NUMERIC) + " FROM x",
        "one_hot": f"WITH {ENCODED} SELECT uid, " + ", ".join(f"cast({c} AS int) AS {c}" for c in ONE_HOT) + " FROM x",
        "assemble": f"""WITH {ENCODED}
SELECT y, slot, count(*) AS n, round(sum(v), 4) AS total, round(max(v), 6) AS largest FROM ({vector_rows}) GROUP BY y, slot""",
        "feature_names": f"WITH {ENCODED}\n" + " UNION ALL ".join(
            f"SELECT {i} AS slot, '{f}' AS feature, round(avg({f}), 6) + 0.0::double AS train_mean FROM x WHERE NOT is_test"
            for i, f in enumerate(VECTOR)),
        "class_weights": f"""WITH {SPLIT},
sizes AS (SELECT label_tactic, count(*) AS n FROM train GROUP BY label_tactic)
SELECT uid, label_tactic,
  round((SELECT sum(n) FROM sizes) / ((SELECT count(*) FROM sizes) * n), 6) AS weight
FROM train JOIN sizes USING (label_tactic)""",
        "gnb_binary": f"WITH {GNB_BINARY} SELECT uid, label, prediction FROM pred",
        "gnb_tactic": f"WITH {GNB_TACTIC} SELECT uid, label, prediction FROM pred",
        "predict": f"""WITH {GNB_BINARY}
SELECT p.uid, p.prediction, round(1 / (1 + exp(max(CASE WHEN cls = 0 THEN lj END) - max(CASE WHEN cls = 1 THEN lj END))), 6) AS p_attack
FROM pred p JOIN joint j ON p.uid = j.uid GROUP BY p.uid, p.prediction""",
        "resume_missing": f"""WITH {SPLIT}
SELECT run, model, status, (SELECT count(*) FROM test) AS n_predictions
FROM (VALUES (1, 'random_forest', 'ok'), (1, 'decision_tree', 'ok'), (2, 'random_forest', 'loaded'), (2, 'decision_tree', 'loaded'),
  (2, 'logistic_regression', 'ok'), (2, 'naive_bayes', 'ok')) v(run, model, status)""",
        "kernel_shap_nb_total": f"""WITH {GNB_BINARY}
SELECT uid, round(1 / (1 + exp(max(CASE WHEN cls = 0 THEN lj END) - max(CASE WHEN cls = 1 THEN lj END))), 6) AS p_attack
FROM joint GROUP BY uid""",
        "hier_rollup": f"""WITH {FLOWS}
SELECT label_tactic || ' - ' || label_technique AS joint, label_tactic AS tactic, count(*) AS n
FROM flows GROUP BY label_tactic, label_technique""",
        **{
            f"{model}_rule": f"WITH {RULE} SELECT uid, rule AS label, rule AS prediction FROM games"
            for model in ("rf", "dt", "lr")
        },
        "tree_shap_rule": _rule_attributions(),
        "tree_shap_interaction_rule": f"""WITH {RULE}
SELECT uid, round(pair, 9) + 0.0 AS "between", round(pair, 9) + 0.0 AS between_back,
  round(phi_a - pair, 9) + 0.0 AS own_state, round(phi_b - pair, 9) + 0.0 AS own_proto FROM values_of""",
        "tree_shap_rf_rule": f"WITH {RULE} SELECT uid, rule FROM games",
        "kernel_shap_model_total": f"WITH {RULE} SELECT uid, cast(rule AS double) AS p_rule FROM games",
        "kernel_shap_rule": _rule_kernel(),
        "hier_rule": f"""WITH {SPLIT},
kinds AS (
  SELECT CASE WHEN conn_state = 'SF' THEN 'open' ELSE 'other' END AS tactic, CASE WHEN proto = 'icmp' THEN 'T1' ELSE 'T2' END AS technique FROM test),
joined AS (SELECT tactic, tactic || ' - ' || technique AS joint FROM kinds)
""" + _perfect("'joint' AS level, ", "joint", "joined") + "\nUNION ALL " + _perfect("'tactic' AS level, ", "tactic", "joined"),
        "balanced_rf_rule": f"""WITH {RULE}, named AS (SELECT CASE WHEN rule = 1 THEN 'yes' ELSE 'no' END AS name FROM games)
{_perfect('', 'name', 'named')}""",
        "train_all_rule": f"""WITH {RULE}, named AS (SELECT CASE WHEN rule = 1 THEN 'yes' ELSE 'no' END AS name FROM games),
report AS ({_perfect('', 'name', 'named')})
SELECT model, 'ok' AS status, report.* FROM report, (SELECT unnest(['forest', 'tree', 'logistic']) AS model)
UNION ALL SELECT 'broken', 'failed: ValueError: no fit', NULL, NULL, NULL, NULL, NULL, NULL""",
        "dt_stump": f"""WITH {RULE}
SELECT uid, rule AS label, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction, round(p, 9) AS p_rule
FROM (SELECT g.uid, rule, CASE WHEN f.a = 1 THEN pb ELSE 0 END AS p FROM games g JOIN flags f ON g.uid = f.uid, shares)""",
        "importance_stump": " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {float(f == 'conn_state_SF')}::double AS importance" for f in VECTOR),
        "split_gains": _split_gains(),
        "lr_gradient": f"WITH {ENCODED},\n{WEIGHTED},\nrows_of AS (SELECT x.*, w FROM x JOIN weighted USING (uid))\n" + " UNION ALL ".join(
            f"SELECT '{n}' AS feature, round(sum(w * r.y * {v}) / count(*), 4) + 0.0 AS moment FROM rows_of r"
            for n, v in [*((f, f) for f in VECTOR), ("intercept", "1.0::double")]),
        "lr_closed_form": f"""WITH {SPLIT},
{WEIGHTED},
known AS (SELECT conn_state, sum(w * y) / sum(w) AS p FROM weighted GROUP BY conn_state)
SELECT uid, round(p, 3) AS p_attack FROM test JOIN known USING (conn_state)""",
        "kmeans_background_values": f"""SELECT unnest(range({len(VECTOR)})) AS slot, 100 AS n_centres, 0 AS n_missing, 1.0::double AS weight""",
        "pdp_rule": f"""WITH {RULE},
test_shares AS (SELECT avg(a) AS pa, avg(b) AS pb FROM flags WHERE is_test)
SELECT 'conn_state_SF' AS feature, 0.0::double AS grid_value, 0.0::double AS avg_probability
UNION ALL SELECT 'conn_state_SF', 1.0, round(pb, 6) FROM test_shares
UNION ALL SELECT 'proto_icmp', 0.0, round(pa, 6) FROM test_shares
UNION ALL SELECT 'proto_icmp', 1.0, 0.0""",
        "importance_tree_rule": _rule_importance(),
        "shap_global": f"""WITH {ENCODED},
{ATTRIBUTION_MEANS}
SELECT "class", feature, round(mean_abs, 6) AS mean_abs FROM summary""",
        "lime_discretizer": _discretizer(),
        "lime_moments": _lime_moments(),
        "pdp_nb": f"WITH {_pdp_nb()}",
        "pdp_grid": f"WITH {GRID} SELECT feature, position, round(grid_value, 6) AS grid_value FROM grid",
        "importance_nb": f"WITH {ENCODED}\n" + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(abs(avg({f}) FILTER (y = 1) - avg({f}) FILTER (y = 0)), 6) AS importance"
            " FROM x WHERE NOT is_test" for f in VECTOR),
    }
