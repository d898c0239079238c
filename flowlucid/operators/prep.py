"""Feature preparation: imputation, scaling, one-hot encoding and assembly.

All statistics come from the train rows. Numeric columns need one aggregate and
categorical columns one count per value; the fitted result is a plain ``PipelineModel``
of Spark ML stages, so it is stored, loaded and applied like any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CATEGORICAL, MAX_CLASSES, MISSING_LABEL, NUMERIC
from .sampling import attach_by_class, class_counts


@dataclass
class FeatureStats:
    """Train statistics. ``std`` is the population deviation *after* mean imputation."""

    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    mode: dict[str, str | None] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)


def numeric_stats(train: DataFrame, cols: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Mean and deviation of every column in one pass.

    Filling with the mean adds rows at distance zero, so the deviation after filling is
    the deviation before times sqrt(present / all): no second pass over the filled data.
    """
    def value(c: str):
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    row = train.agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.struct(F.avg(value(c)).alias("m"), F.stddev_pop(value(c)).alias("s"), F.count(value(c)).alias("n")).alias(c)
            for c in cols
        ],
    ).first()
    mean, std = {}, {}
    for c in cols:
        present = row[c].n
        mean[c] = row[c].m if present else 0.0
        std[c] = row[c].s * math.sqrt(present / row["_n"]) if present else 0.0
    return mean, std


def category_counts(train: DataFrame, cols: list[str]) -> dict[str, dict[str | None, int]]:
    """Rows per value of each categorical column, all columns in one job."""
    rows = (
        train.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols
        ])))
        .groupBy("col", "value").count()
        .limit(MAX_CLASSES * len(cols) + 1).collect()
    )
    out: dict[str, dict[str | None, int]] = {c: {} for c in cols}
    for r in rows:
        out[r.col][r.value] = r["count"]
    for c, counts in out.items():
        if len(counts) > MAX_CLASSES:
            raise ValueError(f"{c} has more than {MAX_CLASSES} categories: not a one-hot column")
    return out


def fit_stats(
    train: DataFrame, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, null_policy: str = "mode",
) -> FeatureStats:
    """``null_policy``: missing categories become the most frequent one ("mode") or their own ("category")."""
    if null_policy not in ("mode", "category"):
        raise ValueError("null_policy is 'mode' or 'category'")
    stats = FeatureStats()
    stats.mean, stats.std = numeric_stats(train, numeric)
    for c, counts in category_counts(train, categorical).items():
        present = {v: n for v, n in counts.items() if v is not None}
        if null_policy == "mode":
            # Most frequent; the smallest value wins a tie.
            stats.mode[c] = min(present, key=lambda v: (-present[v], v)) if present else None
        else:
            stats.mode[c] = MISSING_LABEL
            if None in counts:
                present.setdefault(MISSING_LABEL, counts[None])
        stats.categories[c] = sorted(present)
    return stats


def impute_mean(df: DataFrame, mean: dict[str, float]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) for c, m in mean.items()
    })


def impute_mode(df: DataFrame, mode: dict[str, str | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in mode.items()})


#: Deviations below this share of the mean are rounding noise.
ROUNDING = 1e-12


def _sql_double(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _sql_text(x: str | None) -> str:
    if x is None:
        return "cast(null as string)"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scale_of(mean: float, std: float) -> float:
    """What a centred column is divided by: its deviation, or one where that is nothing but
    rounding of a constant."""
    return std if std > ROUNDING * abs(mean) else 1.0


def build_pipeline(stats: FeatureStats) -> PipelineModel:
    """Stages that turn a flow with derived features into one ``features`` vector.

    A constant column is only centred. Unseen categories become an all-zero block.
    """
    scaled = [
        f"(coalesce(nanvl(cast(`{c}` as double), null), {_sql_double(m)}) - {_sql_double(m)})"
        f" / {_sql_double(scale_of(m, stats.std[c]))} AS `{c}_scaled`"
        for c, m in stats.mean.items()
    ]
    used = [c for c, values in stats.categories.items() if values]
    filled = [f"coalesce(`{c}`, {_sql_text(stats.mode[c])}) AS `{c}_filled`" for c in used]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(scaled + filled)} FROM __THIS__")]
    blocks = [f"{c}_scaled" for c in stats.mean]
    if used:
        # One indexer per column: the constructor for several columns pads shorter lists with nulls.
        indexers = [
            StringIndexerModel.from_labels(
                stats.categories[c], inputCol=f"{c}_filled", outputCol=f"{c}_index", handleInvalid="keep",
            )
            for c in used
        ]
        encoder = OneHotEncoder(
            inputCols=[f"{c}_index" for c in used], outputCols=[f"{c}_onehot" for c in used], dropLast=True,
        )
        # The category sizes are in the index metadata, so fitting the encoder reads no data.
        empty = SparkSession.active().createDataFrame([], ", ".join(f"`{c}_filled` string" for c in used))
        stages += [*indexers, encoder.fit(PipelineModel(indexers).transform(empty))]
        blocks += [f"{c}_onehot" for c in used]
    stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    return PipelineModel(stages)


def fit_prep(train: DataFrame, **options) -> PipelineModel:
    return build_pipeline(fit_stats(train, **options))


def encode(prep: PipelineModel, df: DataFrame) -> DataFrame:
    """The input columns plus ``features``, without the intermediate columns."""
    return prep.transform(df).select(*df.columns, "features")


def feature_names(prep: PipelineModel) -> list[str]:
    """Names in vector order: numerics, then ``column_category`` per one-hot slot."""
    names: list[str] = []
    labels = {s.getOutputCol(): s.labels for s in prep.stages if isinstance(s, StringIndexerModel)}
    assembler = next(s for s in prep.stages if isinstance(s, VectorAssembler))
    for block in assembler.getInputCols():
        if block.endswith("_scaled"):
            names.append(block.removesuffix("_scaled"))
        else:
            column = block.removesuffix("_onehot")
            names += [f"{column}_{value}" for value in labels[f"{column}_index"]]
    return names


def balanced_weights(counts: dict[str, int]) -> dict[str, float]:
    """Balanced weights n / (K * n_c), with K the classes present."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def class_weights(df: DataFrame, label: str) -> dict[str, float]:
    return balanced_weights(class_counts(df, label))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return attach_by_class(df, label, class_weights(df, label), name, T.DoubleType())


def scaled_columns(df: DataFrame, stats: FeatureStats) -> DataFrame:
    """The scaled numerics and one-hot columns as plain columns (the same values as the vector)."""
    out = {
        c: (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) - F.lit(m))
        / F.lit(scale_of(m, stats.std[c]))
        for c, m in stats.mean.items()
    }
    for c, values in stats.categories.items():
        filled = F.coalesce(F.col(c), F.lit(stats.mode[c]))
        out |= {f"{c}_{v}": (filled == v).cast("double") for v in values}
    return df.withColumns(out)
