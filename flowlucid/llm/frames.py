"""Small DataFrame helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(source: DataFrame, added: str, without: str | None = None) -> T.StructType:
    """The fields of ``source`` but ``without``, then the ``added`` ones (DDL)."""
    return T.StructType([f for f in source.schema.fields if f.name != without] + T.StructType.fromDDL(added).fields)


def dropping(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns whose names, in any case, a result needs for itself."""
    taken = {n.lower() for n in names}
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken])
