from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlucid.explain import dependence
from flowlucid.explain.dependence import dependence_by_transform, grid_values, partial_dependence
from flowlucid.explain.importance import compare_importance, importance_values, lr_gradient, split_gains
from flowlucid.explain.kernel import (
    Background, additive_kernel_shap, coalitions, kernel_shap, kernel_shap_by_transform, kmeans_background,
    nearest_values, regression_map, row_background,
)
from flowlucid.explain.lime import (
    bin_table, condition, lime, lime_moments, line_weights, local_fit, moment_sums, perturb, quantile_bins,
)
from flowlucid.explain.summary import long_form, only_supported, shap_summary
from flowlucid.explain.tree import (
    PairSums, _pair_rows, interaction_summary, leaf_sums, node_table, stored_leaves, tree_paths, tree_shap, tree_shap_interactions,
)
from flowlucid.operators.models import fit_dt, fit_gnb, fit_lr, fit_rf, score

M = 5


@pytest.fixture(scope="module")
def small(spark):
    """Five features (the last one 0/1), three classes, uneven weights."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, M))
    x[:, 4] = rng.integers(0, 2, 300)
    y = (x[:, 0] + x[:, 1] * x[:, 4] > 0).astype(int) + (x[:, 2] > 1)
    rows = [(i, *map(float, x[i]), int(y[i]), 0.5 + (i % 3)) for i in range(len(x))]
    cols = [f"f{i}" for i in range(M)]
    df = spark.createDataFrame(rows, "uid long, " + ", ".join(f"{c} double" for c in cols) + ", y int, w double")
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).select("uid", "features", "y", "w").cache()


@pytest.fixture(scope="module")
def forest(small):
    return RandomForestClassifier(labelCol="y", weightCol="w", numTrees=4, maxDepth=5, seed=1).fit(small)


def conditional_expectation(nodes, x, known):
    """Path-dependent expectation of one tree: known features follow x, the others split by weight."""
    def walk(i):
        node = nodes[i]
        stats = np.array(node.stats)
        if node.left < 0:
            return stats / stats.sum()
        if node.feature in known:
            return walk(node.left if x[node.feature] <= node.at else node.right)
        parts = {c: sum(nodes[c].stats) for c in (node.left, node.right)}
        return sum(n * walk(c) for c, n in parts.items()) / sum(parts.values())
    return walk(0)


def brute_force(spark, model, x, m=M):
    trees = {}
    for r in node_table(spark, model).collect():
        trees.setdefault(r.tree, {})[r.id] = r
    value = {
        s: np.mean([conditional_expectation(t, x, set(s)) for t in trees.values()], axis=0)
        for k in range(m + 1) for s in combinations(range(m), k)
    }
    phi = np.zeros((m, len(value[()])))
    pair = np.zeros((m, m, len(value[()])))
    for s in value:
        for j in set(range(m)) - set(s):
            with_j = tuple(sorted((*s, j)))
            phi[j] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (value[with_j] - value[s])
            for i in set(range(m)) - set(s) - {j}:
                delta = value[tuple(sorted((*with_j, i)))] - value[with_j] - value[tuple(sorted((*s, i)))] + value[s]
                pair[i, j] += factorial(len(s)) * factorial(m - len(s) - 2) / factorial(m - 1) / 2 * delta
    for j in range(m):
        pair[j, j] = phi[j] - pair[j].sum(axis=0)
    return value[()], phi, pair


def matrix(row, m=M):
    """The interaction values of a row as a square."""
    out = np.zeros((m, m))
    for i, j, v in zip(row["first"], row["second"], row["values"], strict=True):
        out[i, j] = out[j, i] = v
    return out


def test_tree_values_equal_brute_force(spark, small, forest):
    rows = small.filter("uid < 6")
    got = {(r.uid, r["class"]): r for r in tree_shap(forest, rows).collect()}
    pairs = {r.uid: matrix(r) for r in tree_shap_interactions(forest, rows, 1).collect()}
    for r in rows.select("uid", vector_to_array("features").alias("x")).collect():
        base, phi, pair = brute_force(spark, forest, r.x)
        for c in range(3):
            assert got[r.uid, c].base == pytest.approx(base[c], abs=1e-12)
            assert got[r.uid, c]["values"] == pytest.approx(list(phi[:, c]), abs=1e-10)
        assert np.allclose(pairs[r.uid], pair[:, :, 1], atol=1e-10)


def check_additivity(model, rows, **options):
    total = F.col("base") + F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    explained = tree_shap(model, rows, **options).select("uid", "class", total.alias("total"))
    p = score(model, rows).select("uid", F.posexplode("probability").alias("class", "p"))
    gaps = explained.join(p, ["uid", "class"]).agg(F.max(F.abs(F.col("total") - F.col("p"))), F.count(F.lit(1))).first()
    assert gaps[0] < 1e-9
    return gaps[1]


def test_tree_values_add_up_to_the_probability(small, forest):
    assert check_additivity(forest, small) == 900
    tree = DecisionTreeClassifier(labelCol="y", maxDepth=6).fit(small)
    assert check_additivity(tree, small) == 900
    assert check_additivity(tree, small, class_=2) == 300


def test_deep_paths_and_encoded_rows_add_up(bench):
    model = fit_rf(bench.x_train, "tactic_idx", numTrees=3, maxDepth=20)
    assert check_additivity(model, bench.x_test) == 4 * bench.x_test.count()


def test_pieces_and_files_give_the_same_values(spark, small, forest):
    whole = {(r.uid, r["class"]): r["values"] for r in tree_shap(forest, small).collect()}
    parts = tree_paths(spark, forest, files=5, piece=3)
    assert len(parts.files) > 2
    same = [tuple(leaf.features) for leaf in stored_leaves(tree_paths(spark, forest, files=1))]
    assert len(same) - 1 == len(set(same)) - 1 + sum(a == b for a, b in zip(same, same[1:]))
    split = {(r.uid, r["class"]): r["values"] for r in tree_shap(forest, small, paths=parts).collect()}
    assert whole.keys() == split.keys()
    assert all(np.allclose(whole[k], split[k], atol=1e-12) for k in whole)


def test_interaction_rows_sum_to_the_values(small, forest):
    values = {r.uid: r["values"] for r in tree_shap(forest, small, 1).collect()}
    for r in tree_shap_interactions(forest, small, 1).collect():
        assert np.allclose(matrix(r).sum(axis=1), values[r.uid], atol=1e-10)


def test_interaction_summary_is_the_mean(small, forest):
    pairs = np.mean([np.abs(matrix(r)) for r in tree_shap_interactions(forest, small, 2).collect()], axis=0)
    got = interaction_summary(forest, small, 2).collect()
    assert all(r.mean_abs == pytest.approx(pairs[r["first"], r["second"]], abs=1e-12) for r in got)
    assert {(r["first"], r["second"]) for r in got} >= {(i, j) for i in range(M) for j in range(i, M) if pairs[i, j]}


def test_many_slots_stay_within_the_budget():
    """300 features: rows are taken in blocks, and only pairs that meet are held."""
    rng = np.random.default_rng(0)
    sums = PairSums(300, _pair_rows(300))
    for _ in range(50):
        sums.lines(rng.choice(300, 8, replace=False))
    assert _pair_rows(300) * 300 * 301 // 2 * 8 <= 64 * 1024 * 1024
    a, b, values = sums.found()
    assert len(a) <= 50 * 28 and (a < b).all() and len(values) == len(a)


def test_single_leaf_model(small):
    flat = DecisionTreeClassifier(labelCol="y", maxDepth=0).fit(small)
    assert check_additivity(flat, small) == 900
    assert all(v == 0 for r in tree_shap(flat, small, 1).collect() for v in r["values"])


def test_summaries(spark, small, forest):
    values = tree_shap(forest, small)
    names = [f"f{i}" for i in range(M)]
    wide = {(r["class"], r.feature): r.mean_abs for r in shap_summary(values, names).collect()}
    long = {(r["class"], r.feature): r.mean_abs for r in shap_summary(long_form(values, names)).collect()}
    assert wide == pytest.approx(long) and len(wide) == 3 * M
    support = spark.createDataFrame([(0, 5), (1, 0), (2, 1)], "class int, n_test long")
    assert {r["class"] for r in only_supported(shap_summary(values, names), support).collect()} == {0, 2}


# Kernel ----------------------------------------------------------------------------------


def test_coalition_weights_and_linear_recovery():
    for m, n in ((4, 1000), (6, 40), (20, 2088)):
        masks, weights = coalitions(m, n)
        assert len(masks) <= n and not masks.all(axis=1).any() and masks.any(axis=1).all()
        assert len({r.tobytes() for r in masks}) == len(masks)
        effect = np.linspace(-1, 2, m)
        y = 0.3 + masks @ effect
        a, c = regression_map(masks, weights)
        assert a @ (y - 0.3) + c * effect.sum() == pytest.approx(effect, abs=1e-9)
    assert weights.sum() == pytest.approx(1.0)


def test_full_enumeration_is_exact(spark, small):
    """With every coalition listed the estimate is the Shapley value itself."""
    model = fit_lr(small.withColumn("y", (F.col("y") > 0).cast("int")), "y")
    background = row_background(small, 7)
    rows = small.filter("uid in (100, 101)")
    got = {r.uid: r["values"] for r in kernel_shap(model, rows, background, n_samples=1000).collect()}
    w, b = model.coefficients.toArray(), model.intercept
    for r in rows.select("uid", vector_to_array("features").alias("x")).collect():
        def value(s, x=np.array(r.x)):
            mixed = background.x.copy()
            mixed[:, list(s)] = x[list(s)]
            return (1 / (1 + np.exp(-(mixed @ w + b)))).mean()
        phi = [
            sum(
                factorial(k) * factorial(M - k - 1) / factorial(M) * (value((*s, j)) - value(s))
                for k in range(M) for s in combinations([i for i in range(M) if i != j], k)
            )
            for j in range(M)
        ]
        assert got[r.uid] == pytest.approx(phi, abs=1e-9)


@pytest.mark.parametrize("fit", [fit_lr, fit_gnb])
def test_additive_and_general_estimates_agree(bench, fit):
    model = fit(bench.x_train, "tactic_idx")
    rows = bench.x_test.orderBy("uid").limit(5)
    background = Background(row_background(bench.x_train, 6).x, np.array([0.3, 0.1, 0.1, 0.2, 0.2, 0.1]))
    options = {"n_samples": 120, "class_": 2}
    general = {r.uid: r for r in kernel_shap_by_transform(model, rows, background, **options).collect()}
    additive = {r.uid: r for r in additive_kernel_shap(model, rows, background, **options).collect()}
    assert general.keys() == additive.keys() and len(general) == 5
    p = {r.uid: r.probability[2] for r in score(model, rows).collect()}
    for uid, r in general.items():
        assert additive[uid].base == pytest.approx(r.base, abs=1e-9)
        assert additive[uid]["values"] == pytest.approx(r["values"], abs=1e-9)
        assert r.base + sum(r["values"]) == pytest.approx(p[uid], abs=1e-9)


@pytest.mark.parametrize("n_samples", [18, 1000])
def test_tree_and_general_estimates_agree(small, forest, n_samples):
    rows = small.filter("uid < 20")
    background = Background(row_background(small, 9).x, np.arange(1, 10) / 45)
    for model in (forest, DecisionTreeClassifier(labelCol="y", maxDepth=0).fit(small)):
        general = {r.uid: r for r in kernel_shap_by_transform(model, rows, background, n_samples, class_=2).collect()}
        trees = {r.uid: r for r in kernel_shap(model, rows, background, n_samples, class_=2).collect()}
        assert trees.keys() == general.keys() and len(trees) == 20
        for uid, r in general.items():
            assert trees[uid].base == pytest.approx(r.base, abs=1e-9)
            assert trees[uid]["values"] == pytest.approx(r["values"], abs=1e-9)


def test_too_large_backgrounds_are_refused(small, forest, monkeypatch):
    from flowlucid.explain import kernel

    monkeypatch.setattr(kernel, "MAX_BACKGROUND", 3)
    big = Background(np.zeros((4, M)), np.full(4, 0.25))
    for call in (kernel_shap, kernel_shap_by_transform, additive_kernel_shap):
        with pytest.raises(ValueError, match="3 points"):
            call(fit_gnb(small, "y"), small, big)


def test_kmeans_background_weights(small):
    background = kmeans_background(small, 8)
    assert background.x.shape == (8, M) and background.weight.sum() == pytest.approx(1.0)


# Local surrogates ------------------------------------------------------------------------


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(float(i), 1.0 if i < 30 else 0.0) for i in range(100)], "a double, flag double")
    bins = {(r.feature, r.bin): r for r in quantile_bins(rows, ["a", "flag"]).collect()}
    assert [bins["a", b].n for b in range(4)] == [25, 25, 25, 25]
    assert bins["a", 0]["mean"] == 12.0 and bins["a", 3].high == 99.0
    assert sum(r.share for (f, _), r in bins.items() if f == "flag") == pytest.approx(1.0)


def test_perturbation_depends_on_the_row_only(bench):
    bins = bin_table(bench.x_train, len(bench.names))
    x = np.array(bench.x_test.select(vector_to_array("features")).first()[0])
    a, b = perturb(7, x, bins, range(50), 42), perturb(7, x, bins, range(20, 50), 42)
    assert all((p[20:] == q).all() for p, q in zip(a, b))
    assert (a[0][0] == 1).all() and (a[1][0] == x).all()
    assert not (perturb(8, x, bins, range(50), 42)[1] == a[1]).all()
    # 0/1 slots stay 0/1, and every drawn value lies in its bin.
    assert set(np.unique(a[1][:, 9:])) <= {0.0, 1.0}
    for j, slot in enumerate(bins):
        low, high = min(slot["low"]), max(slot["high"])
        assert ((a[1][1:, j] >= low) & (a[1][1:, j] <= high)).all()


def test_draws_follow_the_bins():
    slot = {"edges": np.array([0.0]), "bins": [0, 1], "share": [0.25, 0.75], "mean": [-1.0, 2.0], "std": [0.5, 0.1], "low": [-2.0, 1.5], "high": [0.0, 2.5]}
    same, rows = perturb("a", np.array([1.0]), [slot], range(20_000), 1)
    assert same[1:].mean() == pytest.approx(0.75, abs=0.01)
    inside = rows[1:, 0][rows[1:, 0] > 0]
    assert inside.mean() == pytest.approx(2.0, abs=0.01) and inside.std() == pytest.approx(0.1, abs=0.01)
    assert condition("f", 1.0, slot) == "f > 0.00" and condition("f", -1.0, slot) == "f <= 0.00"


def plain_ridge(z, y, weight, alpha):
    zc, yc = z - weight @ z / weight.sum(), y - weight @ y / weight.sum()
    return np.linalg.solve(zc.T @ (zc * weight[:, None]) + alpha * np.eye(z.shape[1]), zc.T @ (weight * yc))


def test_local_fit_from_sums():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (4000, 6)).astype(float)
    z[0] = 1
    effect = np.array([0.5, -0.3, 0.0, 0.1, 0.0, 0.0])
    y = 0.2 + z @ effect
    whole = moment_sums(z, y)
    assert np.allclose(whole, moment_sums(z[:1500], y[:1500]) + moment_sums(z[1500:], y[1500:]))
    chosen, coef, intercept, quality = local_fit(whole, 3)
    assert list(chosen) == [0, 1, 3] and coef == pytest.approx([0.5, -0.3, 0.1], abs=0.01) and quality > 0.99
    assert coef == pytest.approx(plain_ridge(z[:, chosen], y, line_weights(z), 1.0))
    residual = y - intercept - z[:, chosen] @ coef
    centred = y - line_weights(z) @ y / line_weights(z).sum()
    assert quality == pytest.approx(1 - (line_weights(z) @ residual**2) / (line_weights(z) @ centred**2), abs=1e-9)


def test_lime_gives_conditions_and_the_prediction(bench):
    rows = bench.x_test.orderBy("uid").limit(2)
    p = {r.uid: list(r.probability) for r in score(bench.model("dt_binary"), rows).collect()}
    got = lime(bench.model("dt_binary"), bench.x_train, rows, bench.names, n_samples=2500, k=4).collect()
    assert len(got) == 8
    for r in got:
        assert r.feature in r.condition and r.probabilities == pytest.approx(p[r.uid])
        assert r.local_prediction == pytest.approx(r.intercept + sum(q.value for q in got if q.uid == r.uid))


def test_array_and_transform_scores_give_the_same_sums(bench, monkeypatch):
    from flowlucid.explain import lime as module

    rows = bench.x_test.orderBy("uid").limit(2)
    for name in ("dt_binary", "gnb_binary", "lr_tactic"):
        def sums():
            found = lime_moments(bench.model(name), bench.x_train, rows, len(bench.names), 1700)
            return {(r.uid, r.i, r.j): r.total for r in found.collect()}
        arrays = sums()
        with monkeypatch.context() as m:
            m.setattr(module, "_scorer", lambda *a: None)
            assert sums() == pytest.approx(arrays)


def test_lime_finds_the_deciding_feature(spark, bench):
    rule = bench.features.select("uid", (F.col("resp_pkts") > 20).cast("int").alias("target"))
    train = bench.x_train.join(rule, "uid")
    rows = bench.x_test.orderBy("uid").limit(2)
    got = lime(fit_dt(train, "target"), train, rows, bench.names, n_samples=500, k=3).collect()
    assert len(got) == 6
    for uid in {r.uid for r in got}:
        assert max((r for r in got if r.uid == uid), key=lambda r: abs(r.value)).feature == "resp_pkts"


# Dependence and importance ---------------------------------------------------------------


def test_dependence_of_many_rows_from_one_pass(bench, monkeypatch):
    """The leaves pass by once for some 10,000 rows, a bit for each; sums are those of forced rows."""
    passes = []
    monkeypatch.setattr(dependence, "stored_leaves", lambda paths: passes.append(1) or stored_leaves(paths))
    rng = np.random.default_rng(3)
    seen = np.array([r.x for r in bench.x_test.select(vector_to_array("features").alias("x")).collect()])
    x = rng.permuted(np.tile(seen, (10001 // len(seen) + 1, 1))[:10001], axis=0)
    curves = dependence.TreeCurves(bench.paths("dt_signal"), 1)
    grids = {f: np.linspace(x[:, f].min(), x[:, f].max(), 5) for f in (0, 1, 8)}
    batches = (pd.DataFrame({"x": list(part)}) for part in np.array_split(x, 7))
    blocks = [b for _, b in dependence._row_blocks(batches, dependence.marked_rows(x.shape[1]))]
    got = [curves.of(b, grids) for b in blocks]
    assert len(passes) == len(got) == 1
    for f, grid in grids.items():
        for value, total in zip(grid, got[0][f], strict=True):
            forced = x.copy()
            forced[:, f] = value
            assert total == pytest.approx(leaf_sums(forced, curves.paths, 1).sum(), rel=1e-9)
    marks = dependence.Marks(x)
    assert marks.meets(0, -np.inf, np.inf).nbytes == 8 * 157 and marks.count([marks.meets(0, -np.inf, np.inf)]) == 10001


def test_dependence_of_a_flat_and_a_step_model(bench):
    flat = DecisionTreeClassifier(labelCol="y", maxDepth=0).fit(bench.x_train)
    p = {round(r.avg_probability, 12) for r in partial_dependence(flat, bench.x_test, bench.names, [0, 1], 5).collect()}
    assert len(p) == 1
    rule = bench.features.select("uid", (F.col("resp_pkts") > 20).cast("int").alias("target"))
    step = fit_dt(bench.x_train.join(rule, "uid"), "target")
    curve = partial_dependence(step, bench.x_test, bench.names, [1]).orderBy("grid_value").collect()
    values = [r.avg_probability for r in curve]
    assert values == sorted(values) and values[0] == 0.0 and values[-1] == 1.0


def test_curves_on_arrays_equal_scoring_every_row(bench, small, forest):
    models = {"dt": bench.model("dt_binary"), "lr": bench.model("lr_tactic"), "nb": bench.model("gnb_tactic"), "rf": fit_rf(bench.x_train, "y", numTrees=3, maxDepth=6)}
    slot = {bench.names[i]: i for i in (0, 1, 8, 12)}
    x = bench.x_test.select(vector_to_array("features").alias("x"))
    for model in models.values():
        got = partial_dependence({"m": model}, bench.x_test, bench.names, list(slot.values()), 7)
        grids = {c: [r.grid_value for r in got.filter(F.col("feature") == c).orderBy("position").collect()] for c in slot}
        expected = {(r.feature, r.position): r.avg_probability for r in dependence_by_transform({"m": model}, x, bench.names, slot, grids).collect()}
        assert {(r.feature, r.position): r.avg_probability for r in got.collect()} == pytest.approx(expected, abs=1e-9)


def test_grid(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3)) for i in range(1001)], "many double, few double")
    grids = grid_values(rows, ["many", "few"], 100)
    assert grids["few"] == [0.0, 1.0, 2.0]
    assert grids["many"] == pytest.approx(list(np.linspace(50, 950, 100)))


def test_importance(spark, bench):
    models = {"rf": fit_rf(bench.x_train, "y", numTrees=5, maxDepth=4), "lr": fit_lr(bench.x_train, "y"),
              "nb": fit_gnb(bench.x_train, "y"), "dt": fit_dt(bench.x_train, "y")}
    assert importance_values(models["rf"]).sum() == pytest.approx(1.0)
    assert importance_values(models["dt"]).sum() == pytest.approx(1.0)
    assert importance_values(models["lr"]) == pytest.approx(np.abs(models["lr"].coefficients.toArray()))
    table = compare_importance(spark, models, bench.names).collect()
    assert len(table) == 4 * len(bench.names)
    assert {r.rank for r in table if r.model == "lr"} == set(range(1, len(bench.names) + 1))


def test_split_gains_against_plain_counts(small):
    rows = small.select("y", vector_to_array("features").alias("x"), "w").collect()
    cuts = {0: [-0.5, 0.4], 4: [0.5], 2: [9.0]}
    got = {(r.slot, r.threshold): r.gain for r in split_gains(small, "y", cuts, F.col("w")).collect()}

    def impurity(part):
        total = sum(r.w for r in part)
        return total - sum(sum(r.w for r in part if r.y == c) ** 2 for c in range(3)) / total if total else 0.0

    for slot, many in cuts.items():
        for t in many:
            sides = [[r for r in rows if (r.x[slot] > t) == up] for up in (False, True)]
            assert got[slot, t] == pytest.approx((impurity(rows) - sum(map(impurity, sides))) / sum(r.w for r in rows))


def test_centres_get_values_of_their_columns(small):
    x = np.array([r.x for r in small.select(vector_to_array("features").alias("x")).collect()])
    centres = np.vstack([np.linspace(-3, 3, M), np.zeros(M), np.full(M, 50.0), np.full(M, 0.5)])
    moved = nearest_values(small.repartition(3), centres)
    for j in range(M):
        for c, v in zip(centres[:, j], moved[:, j], strict=True):
            assert v in x[:, j] and abs(v - c) == pytest.approx(np.abs(x[:, j] - c).min())


def test_gradient_vanishes_at_the_optimum_only(bench):
    from flowlucid.operators.prep import with_class_weight

    rows, n = with_class_weight(bench.x_train, "y"), bench.x_train.count()
    for C, limit in ((1.0, 1e-4), (0.01, 1e-4)):
        model = fit_lr(bench.x_train, "y", C=C)
        for r in lr_gradient(model, rows, "y", F.col("weight"), bench.names, C).collect():
            assert abs(r.fitted - r.wanted) / n < limit
    off = [abs(r.fitted - r.wanted) / n for r in lr_gradient(model, rows, "y", F.col("weight"), bench.names, 1.0).collect()]
    assert max(off) > 1e-3
