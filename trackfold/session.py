"""Session settings, and the shared folder for data that has to survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


# With a byte limit the size of the whole batch is taken again for every row that has an array
# column, which costs more than the scans themselves. The row limit per batch stays.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the scan operators run well with; what the user has set stays."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def _qualified(context: SparkContext, path: str) -> str:
    """The path with its scheme; without one it lies in ``fs.defaultFS``."""
    named = context._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(context._jsc.hadoopConfiguration())
    return system.makeQualified(named).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, once. A cluster session
    without it is refused: a machine-local folder would be lost with its machine. A path without
    a scheme is one of the default file system, as everywhere in Spark; on a cluster the driver says
    so once, so that all machines take it for the same place. ``file:`` is taken at its word, for a
    folder that all machines mount.
    """
    context = spark.sparkContext
    cluster = not context.master.startswith("local")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return (_qualified(context, named) if cluster else named).rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if cluster:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trackfold-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


# the folder found for an application, by the one it names
_found: dict[tuple[str, str], str] = {}


def seen_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether what the executors write to the folder is all there when it is read again.

    A folder that each machine has for itself raises no error: the driver finds no files there,
    commits an empty table, and every row is lost.
    """
    path, tasks = f"{folder}/seen-{uuid.uuid4().hex}", 2 * spark.sparkContext.defaultParallelism
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id bigint").parquet(path).count() == tasks
    except (Py4JJavaError, PySparkException):
        return False


def shared_folder(spark: SparkSession) -> str:
    """``shared_dir``, tried once for an application whose executors are processes of their own.

    ``spark.checkpoint.dir`` can be a default of the installation that no machine shares. Then the folder
    given to ``setCheckpointDir`` is taken, or else one in the warehouse, if all executors reach that.
    """
    named, context = shared_dir(spark), spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return named
    key = (context.applicationId, named)
    if key not in _found:
        others = (context.getCheckpointDir(), f"{spark.conf.get('spark.sql.warehouse.dir')}/trackfold-scratch")
        folder = next((f.rstrip("/") for f in (named, *others) if f and seen_by_all(spark, f.rstrip("/"))), None)
        if folder is None:
            raise ValueError(f"set spark.checkpoint.dir to a folder every executor can reach; {named} is not one")
        if folder != named:
            warnings.warn(f"not all executors reach {named}; {folder} is taken for it")
        _found[key] = folder
    return _found[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder, and go on from that table.

    With ``by`` the table is laid out in folders, so a join on those columns reads few of them.
    A table rather than ``checkpoint()``, which computes its input twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
