"""Exact path-dependent Shapley values of tree models, as one narrow Spark job over the rows.

Every leaf is a product game: with S the known features, the leaf counts as reached
with weight  prod_{i in S} o_i * prod_{i not in S} z_i,  where o_i says whether the row
meets the leaf's interval on feature i and z_i is the share of training weight that
follows the path there. Its Shapley value is

    phi_j = v * (o_j - z_j) * integral_0^1 prod_{i != j} (z_i (1 - t) + o_i t) dt,

a polynomial in t, so a short Gauss-Legendre rule integrates it exactly.

The paths are a Parquet table that executors write, leaves with the same features next to
each other. Spark hands its files to every executor's disk (``SparkContext.addFile``), and each
Arrow batch of rows has them pass by in bounded pieces: nothing of the size of the model is
held on the driver, in a broadcast or in a task, and rows are read once and never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import list_files, scratch_dir, ship_package
from ..schema import KEY

# Leaves that a task holds at a time.
PIECE_LEAVES = 4096
# Rows explained together, and bytes of what is summed up for them.
BLOCK_ROWS = 4096
BLOCK_BYTES = 64 * 1024 * 1024
# Bytes of remembered answers to "which rows meet this interval".
INTERVAL_BYTES = 64 * 1024 * 1024

PATH_SCHEMA = (
    "tree int, features array<int>, low array<double>, high array<double>, share array<double>, value array<double>"
)


def tree_model(model: Model) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """The nodes of a tree or forest, read back from its stored form."""
    path = scratch_dir(spark, "trees")
    tree_model(model).save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "nodeData" in stored.columns:
        nodes = stored.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = stored.withColumn("tree", F.lit(0))
    return nodes.select(
        F.col("tree").cast("int").alias("tree"), "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("at"),
        F.size("split.leftCategoriesOrThreshold").alias("n_left"),
        F.col("split.numCategories").alias("categories"),
        F.col("impurityStats").alias("stats"),
    )


def paths_of_tree(nodes: pd.DataFrame) -> pd.DataFrame:
    """Root-to-leaf paths of one tree, with repeated features merged into one interval."""
    by_id = {r.id: r for r in nodes.itertuples()}
    cover = {i: float(np.sum(r.stats)) for i, r in by_id.items()}
    out, todo = [], [(0, {})]
    while todo:
        i, steps = todo.pop()
        node = by_id[i]
        if node.left < 0:
            low, high, share = zip(*steps.values()) if steps else ((), (), ())
            out.append((node.tree, list(steps), list(low), list(high), list(share), list(np.asarray(node.stats) / cover[i])))
            continue
        if node.categories > 2:
            raise ValueError("splits on categorical features of more than two values are not supported")
        if node.categories == 2:
            # A 0/1 slot: the left child takes the one listed value.
            threshold, left_is_low = 0.5, node.at == 0.0
        else:
            threshold, left_is_low = node.at, True
        lower, upper = (node.left, node.right) if left_is_low else (node.right, node.left)
        lo, hi, z = steps.get(node.feature, (-np.inf, np.inf, 1.0))
        todo.append((lower, {**steps, node.feature: (lo, min(hi, threshold), z * cover[lower] / cover[i])}))
        todo.append((upper, {**steps, node.feature: (max(lo, threshold), hi, z * cover[upper] / cover[i])}))
    return pd.DataFrame(out, columns=["tree", "features", "low", "high", "share", "value"])


@dataclass
class TreePaths:
    """The stored paths of a model: the names of their files, the base value per class, and sizes."""

    files: list[str]
    base: np.ndarray
    flat: np.ndarray  # the part of the base that trees of a single leaf give
    n_features: int
    piece: int = PIECE_LEAVES

    @property
    def n_classes(self) -> int:
        return len(self.base)


def tree_paths(spark: SparkSession, model: Model, files: int | None = None, piece: int = PIECE_LEAVES) -> TreePaths:
    """Writes the paths of every leaf, by tree, and gives the files to the executors.

    ``files`` (default: one for each core) only spreads the writing; equal features meet in
    one file, next to each other.
    """
    ship_package(spark)
    nodes, path = node_table(spark, model), scratch_dir(spark, "paths")
    trees = nodes.select("tree").distinct().count()
    found = nodes.groupBy("tree").applyInPandas(paths_of_tree, PATH_SCHEMA).select(
        "features", "low", "high", "share", F.transform("value", lambda v: v / trees).alias("value"),
    )
    found.repartition(files or spark.sparkContext.defaultParallelism, "features").sortWithinPartitions(F.size("features"), "features").write.parquet(path)
    reached = F.aggregate("share", F.lit(1.0), lambda a, z: a * z)
    n = tree_model(model).numClasses
    stored = spark.read.parquet(path)
    alone = F.when(F.size("features") == 0, 1.0).otherwise(0.0)
    sums = stored.agg(*[F.sum(F.get("value", F.lit(c)) * part) for part in (reached, alone) for c in range(n)]).first()
    names = []
    for file in list_files(spark, path):
        spark.sparkContext.addFile(file)
        names.append(file.rsplit("/", 1)[-1])
    return TreePaths(names, np.array(sums[:n], dtype=float), np.array(sums[n:], dtype=float), tree_model(model).numFeatures, piece)


@dataclass
class Leaf:
    """One leaf's path: its distinct features, interval and share of each, and the value per class."""

    features: np.ndarray
    low: list[float]
    high: list[float]
    share: np.ndarray
    value: np.ndarray


def stored_leaves(paths: TreePaths, open_: Callable[[str], str] = SparkFiles.get) -> Iterator[Leaf]:
    """Every leaf with a path, ``paths.piece`` of them in memory at a time."""
    for name in paths.files:
        for part in pq.ParquetFile(open_(name)).iter_batches(batch_size=paths.piece):
            columns = [part.column(c) for c in ("features", "low", "high", "share", "value")]
            features, low, high, share, value = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
            ends = columns[0].offsets.to_numpy() - columns[0].offsets[0].as_py()
            value = value.reshape(part.num_rows, -1)
            for i in range(part.num_rows):
                a, b = ends[i], ends[i + 1]
                if a < b:
                    yield Leaf(features[a:b], low[a:b].tolist(), high[a:b].tolist(), share[a:b], value[i])


@lru_cache(maxsize=64)
def _rule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on [0, 1], exact for polynomials of degree ``size``."""
    t, w = np.polynomial.legendre.leggauss(size // 2 + 1)
    return (t + 1) / 2, w / 2


def _quadrature(size: int, share: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """g_i(t) = z_i (1 - t) + o_i t at the nodes of a rule exact for degree ``size``, and the weights."""
    t, w = _rule(size)
    return share[..., None] * (1 - t) + on[..., None] * t, w


def path_weights(share: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Shapley values of unit leaves: one per feature on the path (last axis)."""
    g, w = _quadrature(share.shape[-1] - 1, share, on)
    return (on - share) * ((g.prod(axis=-2, keepdims=True) / g) @ w)


@lru_cache(maxsize=64)
def _pairs(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size, 1)


def path_pairs(share: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Interaction values of unit leaves, halved, for the pairs i < j (last axis, in the order of ``_pairs``)."""
    first, second = _pairs(share.shape[-1])
    g, w = _quadrature(max(share.shape[-1] - 2, 0), share, on)
    gap, inverse = on - share, 1 / g
    without_two = (inverse * (g.prod(axis=-2, keepdims=True) * w))[..., first, :] * inverse[..., second, :]
    return 0.5 * gap[..., first] * gap[..., second] * without_two.sum(axis=-1)


class Block:
    """The columns of some rows, and which rows meet which interval."""

    def __init__(self, columns: np.ndarray):
        self.columns = columns  # (features, rows)
        self.known: dict[tuple, np.ndarray] = {}

    def meets(self, feature: int, low: float, high: float) -> np.ndarray:
        key = (feature, low, high)
        found = self.known.get(key)
        if found is None:
            v = self.columns[feature]
            found = ((v > low) & (v <= high)).astype(np.int32)
            if len(self.known) * found.nbytes > INTERVAL_BYTES:
                self.known.clear()
            self.known[key] = found
        return found

    def patterns(self, leaf: Leaf) -> tuple[np.ndarray, np.ndarray]:
        """The combinations of met intervals that occur, one line each, and each row's."""
        size = len(leaf.features)
        code = np.zeros(self.columns.shape[1], dtype=np.int32)
        for d, (f, a, b) in enumerate(zip(leaf.features.tolist(), leaf.low, leaf.high, strict=True)):
            code |= self.meets(f, a, b) << d
        if size <= 16:
            place = np.zeros(1 << size, dtype=np.int32)
            place[code] = 1
            seen = np.flatnonzero(place)
            place[seen] = np.arange(len(seen))
            where = place[code]
        else:
            seen, where = np.unique(code, return_inverse=True)
        return ((seen[:, None] >> np.arange(size)) & 1).astype(float), where


def shap_block(x: np.ndarray, paths: TreePaths, classes: list[int]) -> np.ndarray:
    """(classes, features, rows) attributions of a block of rows."""
    block = Block(np.ascontiguousarray(x.T))
    total = np.zeros((len(classes), x.shape[1], len(x)))
    for leaf in stored_leaves(paths):
        on, where = block.patterns(leaf)
        weights = np.take(path_weights(leaf.share, on).T, where, axis=1)
        for k, c in enumerate(classes):
            if leaf.value[c]:
                total[k, leaf.features] += weights * leaf.value[c]
    return total


def leaf_sums(x: np.ndarray, paths: TreePaths, cls: int) -> np.ndarray:
    """The class's probability for each row, from the leaves it reaches."""
    block, total = Block(np.ascontiguousarray(x.T)), np.full(len(x), paths.flat[cls])
    for leaf in stored_leaves(paths):
        if leaf.value[cls]:
            met = None
            for f, a, b in zip(leaf.features.tolist(), leaf.low, leaf.high, strict=True):
                one = block.meets(f, a, b)
                met = one if met is None else met & one
            total += met * leaf.value[cls]
    return total


class PairSums:
    """Interaction values of a block of rows, only for the pairs of features that meet on a path."""

    def __init__(self, n_features: int, n_rows: int):
        self.n_features, self.n_rows = n_features, n_rows
        self.line = np.full(n_features * n_features, -1, dtype=np.int64)
        self.keys: list[int] = []
        self.sums = np.zeros((16, n_rows))

    def lines(self, features: np.ndarray) -> np.ndarray:
        first, second = _pairs(len(features))
        a, b = features[first].astype(np.int64), features[second].astype(np.int64)
        keys = np.minimum(a, b) * self.n_features + np.maximum(a, b)
        found = self.line[keys]
        for k in np.flatnonzero(found < 0).tolist():
            self.line[keys[k]] = found[k] = len(self.keys)
            self.keys.append(int(keys[k]))
        if len(self.keys) > len(self.sums):
            grown = np.zeros((max(len(self.keys), 2 * len(self.sums)), self.n_rows))
            grown[:len(self.sums)] = self.sums
            self.sums = grown
        return found

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smaller and greater feature and sums of each pair."""
        a, b = np.divmod(np.array(self.keys, dtype=np.int64), self.n_features)
        return a, b, self.sums[:len(self.keys)]


def pair_block(x: np.ndarray, paths: TreePaths, cls: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b, their halved interaction values (pairs, rows), and the attributions (features, rows)."""
    block = Block(np.ascontiguousarray(x.T))
    pairs, single = PairSums(x.shape[1], len(x)), np.zeros((x.shape[1], len(x)))
    for leaf in stored_leaves(paths):
        v = leaf.value[cls]
        if not v:
            continue
        on, where = block.patterns(leaf)
        single[leaf.features] += np.take(path_weights(leaf.share, on).T * v, where, axis=1)
        if len(leaf.features) > 1:
            lines = pairs.lines(leaf.features)
            pairs.sums[lines] += np.take(path_pairs(leaf.share, on).T * v, where, axis=1)
    return *pairs.found(), single


def _row_blocks(batches: Iterator[pd.DataFrame], limit: int = BLOCK_ROWS) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """All rows of a partition in blocks: every block lets the whole model pass by once."""
    waiting, n = [], 0
    for rows in batches:
        for at in range(0, len(rows), limit):
            part = rows.iloc[at:at + limit]
            if n + len(part) > limit:
                yield _stacked(waiting)
                waiting, n = [], 0
            waiting.append(part)
            n += len(part)
    if n:
        yield _stacked(waiting)


def _stacked(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
    rows = pd.concat(parts, ignore_index=True)
    return rows, np.stack(rows["x"].to_numpy())


def _feature_rows(df: DataFrame, key: str) -> DataFrame:
    """Few partitions rather than many small ones: a block costs one pass over the model."""
    rows = df.select(key, vector_to_array("features").alias("x"))
    return rows.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def tree_shap(
    model: Model, df: DataFrame, class_: int | None = None, key: str = KEY, paths: TreePaths | None = None,
) -> DataFrame:
    """Attributions (uid, class, base, values) of the model's class probabilities.

    ``base`` plus the sum of ``values`` is the model's probability of the class. All
    classes are explained in the same pass unless ``class_`` names one.
    """
    spark = df.sparkSession
    ship_package(spark)
    paths = paths or tree_paths(spark, model)
    classes = list(range(paths.n_classes)) if class_ is None else [class_]
    # probabilities sum to one, so the last class's attributions are known from the others'
    summed = classes[:-1] if len(classes) == paths.n_classes > 1 else classes
    key_type = df.schema[key].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in _row_blocks(batches):
            total = shap_block(x, paths, summed)
            for k, c in enumerate(classes):
                values = total[k] if k < len(summed) else -total.sum(axis=0)
                yield pd.DataFrame({key: rows[key], "class": c, "base": float(paths.base[c]), "values": list(values.T)})

    return _feature_rows(df, key).mapInPandas(explain, f"{key} {key_type}, class int, base double, values array<double>")


def _pair_rows(n_features: int) -> int:
    """Rows whose sums for all pairs stay within ``BLOCK_BYTES``."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, n_features * (n_features + 1) // 2))))


def tree_shap_interactions(
    model: Model, df: DataFrame, class_: int = 1, key: str = KEY, paths: TreePaths | None = None,
) -> DataFrame:
    """Interaction values (uid, class, base, first, second, values) of every row: of each pair of
    features that meet on a path, once with first < second (half of the joint effect, the
    same both ways round), and of each feature with itself. A feature's line of these sums up to its
    attribution; pairs that are not listed are zero."""
    spark = df.sparkSession
    ship_package(spark)
    paths = paths or tree_paths(spark, model)
    key_type = df.schema[key].dataType.simpleString()
    base = float(paths.base[class_])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in _row_blocks(batches, _pair_rows(paths.n_features)):
            a, b, pairs, single = pair_block(x, paths, class_)
            own = _own(a, b, pairs, single)
            diagonal = np.arange(len(own))
            first, second = np.concatenate([diagonal, a]), np.concatenate([diagonal, b])
            values = np.concatenate([own, pairs])
            yield pd.DataFrame({
                key: rows[key], "class": class_, "base": base,
                "first": [first] * len(rows), "second": [second] * len(rows), "values": list(values.T),
            })

    return _feature_rows(df, key).mapInPandas(
        explain, f"{key} {key_type}, class int, base double, first array<int>, second array<int>, values array<double>",
    )


def _own(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, single: np.ndarray) -> np.ndarray:
    """What is left of each attribution for the feature alone."""
    own = single.copy()
    np.subtract.at(own, a, pairs)
    np.subtract.at(own, b, pairs)
    return own


def interaction_summary(model: Model, df: DataFrame, class_: int = 1, paths: TreePaths | None = None) -> DataFrame:
    """(class, first, second, mean_abs): the mean |interaction value| over all rows, for every pair
    first <= second of features that meet on a path. Each task sums up its rows, so one line for each
    pair and task is shuffled, whatever the number of rows."""
    spark = df.sparkSession
    ship_package(spark)
    paths = paths or tree_paths(spark, model)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, x in _row_blocks(batches, _pair_rows(paths.n_features)):
            a, b, pairs, single = pair_block(x, paths, class_)
            own = np.arange(len(single))
            yield pd.DataFrame({
                "first": np.concatenate([own, a]), "second": np.concatenate([own, b]), "n": len(rows),
                "total": np.concatenate([np.abs(_own(a, b, pairs, single)).sum(axis=1), np.abs(pairs).sum(axis=1)]),
            })

    rows = _feature_rows(df, df.columns[0])
    sums = rows.mapInPandas(explain, "first int, second int, n long, total double")
    # every block meets the same paths, so each pair has all rows
    summed = sums.groupBy("first", "second").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return summed.select(F.lit(class_).alias("class"), "first", "second", (F.col("total") / F.col("n")).alias("mean_abs"))
