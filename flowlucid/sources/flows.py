"""Reading and laying out flow tables kept as weekly Parquet directories."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import list_files
from ..functions import week_start
from ..schema import FLOW_SCHEMA


def matching_directories(spark: SparkSession, patterns: list[str], exclude: str) -> list[str]:
    """Directories that match the globs, on whatever file system Spark uses."""
    found = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(path) or []:
            if status.isDirectory() and exclude not in status.getPath().getName():
                found.append(status.getPath().toString())
    return sorted(set(found))


def read_flows(
    spark: SparkSession, patterns: str | list[str], exclude: str = "_parquet_", files: str = "*.parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """All weekly directories matching the globs as one table with canonical types.

    Files whose common columns have one type are read as one scan. Where types differ each
    group of files is cast on its own, so a wider type in one week does not force a slow
    reader on the rest. The footers of all files are read by Spark jobs (see ``schema_groups``);
    with a declared ``schema``, which all files must then have, none is opened.
    """
    patterns = [patterns] if isinstance(patterns, str) else patterns
    directories = matching_directories(spark, patterns, exclude)
    if not directories:
        raise FileNotFoundError(f"no flow directory matches {patterns}")
    reader = spark.read.option("pathGlobFilter", files)
    parents = {d.rsplit("/", 1)[0] for d in directories}
    if len(parents) == 1 and all("=" in d.rsplit("/", 1)[1] for d in directories):
        # key=value directories: the key becomes a column whose filters prune directories.
        reader = reader.option("basePath", parents.pop())
    if schema is not None:
        return canonical(reader.schema(schema).parquet(*directories))
    parts = [canonical(reader.schema(found).parquet(*paths)) for found, paths in schema_groups(spark, reader, directories)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def schema_groups(spark: SparkSession, reader: DataFrameReader, directories: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Directories, or files of a mixed directory, by merged schema: each column of a group has one type.

    Spark merges the footers of all files in one job. Only where types differ the list is
    halved and each half is merged on its own; a directory that still differs is
    halved by files. Weeks are in order of time, as are changes of types, so n
    directories with g changes take about g * log2(n) jobs. Groups whose common columns agree
    are then put together.
    """
    merging, groups = reader.option("mergeSchema", True), []
    waiting = [directories]
    while waiting:
        paths = waiting.pop()
        try:
            found = merging.parquet(*paths).schema
        except (PySparkException, Py4JJavaError) as error:  # the second where a footer job's error comes as it is
            if "CANNOT_MERGE_SCHEMAS" not in str(error):
                raise
            if len(paths) == 1:
                paths = list_files(spark, paths[0])
            if len(paths) == 1:
                raise
            waiting += [paths[len(paths) // 2:], paths[:len(paths) // 2]]
            continue
        for i, (known, members) in enumerate(groups):
            types = {f.name.lower(): f.dataType for f in known}
            if all(types.get(f.name.lower(), f.dataType) == f.dataType for f in found):
                added = [f for f in found if f.name.lower() not in types]
                groups[i] = (T.StructType([*known.fields, *added]), members + paths)
                break
        else:
            groups.append((found, paths))
    return groups


def canonical(df: DataFrame) -> DataFrame:
    """Known columns cast to their canonical type; other columns are kept as they are."""
    known = {f.name: f.dataType for f in FLOW_SCHEMA}
    return df.select(*[
        F.col(c).cast(known[c]).alias(c) if c in known and df.schema[c].dataType != known[c] else F.col(c)
        for c in df.columns
    ])


def register_view(df: DataFrame, name: str = "flows") -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def write_weekly_flows(df: DataFrame, path: str, ts: str = "ts", partitions: int | None = None) -> None:
    """Write one directory per week.

    Range partitioning on (week, ts) cuts a week that holds much of the data into many
    tasks, and keeps each task to few weeks, so there are few small files.
    """
    keyed = df.withColumn("week", week_start(ts))
    order = [F.col("week"), F.col(ts)]
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    ranged.write.mode("overwrite").partitionBy("week").parquet(path)
