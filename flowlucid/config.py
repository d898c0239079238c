"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app: str = "flowlucid", cpus: int | str = "*", memory: str = "4g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession, root: str | None = None) -> str:
    """The folder for intermediate tables: ``root``, or what ``spark.checkpoint.dir`` names.

    A cluster has to name one that driver and executors share (a ``file:`` path may be a
    shared mount, so the setting is taken at its word). Only a local session, where they
    are one process, may fall back to a temporary folder, one for each application; the
    session's settings are never changed.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="flowlucid-")
        root = _own_roots[app]
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A fresh path in the scratch folder."""
    return f"{scratch_root(spark, root)}/{name}-{uuid.uuid4().hex}"


def can_checkpoint(spark: SparkSession) -> bool:
    """Whether Spark has a folder for checkpoints; one that has none is given a scratch folder,
    unless there is no such folder either."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        try:
            context.setCheckpointDir(scratch_dir(spark, "checkpoints"))
        except ValueError:
            return False
    return True


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``scratch_dir`` named, on whatever store it lies."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: Files of a scratch table, at most: so many for each core, or this number.
FILES_EACH, FEW_FILES = 4, 32


def few_files(df: DataFrame) -> DataFrame:
    """``df`` as it is to be written after a shuffle: where that has many partitions for the cores,
    a task works off several in turn into one file, without another shuffle. Spark's executors may
    start a process for the rights of each file, which costs more than a small table's rows.
    """
    return df.coalesce(max(FEW_FILES, FILES_EACH * df.sparkSession.sparkContext.defaultParallelism))


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are written: its cleaner does so
    once the driver has collected their plans, which may otherwise take long."""
    gc.collect()
    spark._jvm.System.gc()


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a written table, on whatever store it lies."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    names = sorted(f.getPath().toString() for f in found)
    return [n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", "."))]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per application.

    Spark copies the archive to every executor, also to one that joins later; only the
    driver reads the file made here.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='flowlucid-')}/flowlucid", "zip", package.parent, package.name,
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def small_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A driver-made table (per class, per week, per grid point) as a local relation.

    Its exact size is in the plan, so Spark itself decides whether to broadcast it.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    arrow = pa.Table.from_pylist([dict(zip(names, row, strict=True)) for row in rows], to_arrow_schema(schema))
    return spark.createDataFrame(arrow, schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by key over so many partitions, by default twice the cores.

    Meant before work that is heavy per row over a table of few files.
    """
    return df.repartition(partitions or 2 * df.sparkSession.sparkContext.defaultParallelism, key)
