"""Session helpers: shipping this package to executors and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_grainfold_dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sc._grainfold_dir = f"file://{tempfile.mkdtemp(prefix='grainfold-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session has no file system to ask
        with contextlib.suppress(Exception):  # nor has one whose JVM went first
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The shuffle files of the write go when it ends (CLEANUP). by: columns by whose values the files are parted.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """df dealt out to all cores if it is read in fewer parts than there are cores, as one file with one row group is, and has
    least_bytes or more. A large table has parts enough and stays as it is. Filters and columns still reach the scan."""
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    few = execution.optimizedPlan().stats().sizeInBytes() >= least_bytes and execution.toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def sized(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has no more than `most` rows, which is counted, and to be shuffled otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
