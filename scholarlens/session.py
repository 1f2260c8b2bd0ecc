"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "scholarlens", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where they are given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (builder.master(master).config("spark.driver.memory", "8g")
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context."""
    context = spark.sparkContext
    name = __name__.split(".")[0]
    if any(str(path).endswith(f"{name}.zip") for path in context._python_includes):
        return
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name)
    context.addPyFile(shutil.make_archive(archive, "zip", parent, name))


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a folder of one
    machine would be invisible to the executors and lost with the machine.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="scholarlens-")
    context.setCheckpointDir(root)
    return root


#: Paths given out inside each open or closed scope, by application and name of the scope.
_SCOPES: dict[tuple[str, str], list[str]] = {}
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Puts the scratch tables written inside the block down to ``name``, for ``release``."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope. Nothing may still read them."""
    conf = spark._jsc.hadoopConfiguration()
    for path in _SCOPES.pop((spark.sparkContext.applicationId, name), []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the scratch folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _SCOPE.get():
        _SCOPES.setdefault((spark.sparkContext.applicationId, _SCOPE.get()), []).append(path)
    return path


#: Lets Spark delete the shuffle files of a query when the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage, outlives executors.

    What the write shuffled is deleted at its end, so a chain of written tables holds the
    shuffle files of one of them at a time. ``codec`` suits a table that carries whole texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _set(spark, CLEAN_SHUFFLES, "true"):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


#: Lets Spark run one task for all frames of a union that have one partition each.
ZIP_UNIONS = "spark.sql.unionOutputPartitioning"


def written_apart(parts: list[DataFrame], label: str) -> DataFrame:
    """Write frames of one partition each as one table, in a task for each of them."""
    with _set(parts[0].sparkSession, ZIP_UNIONS, "false"):
        return written(reduce(DataFrame.unionByName, parts), label)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder stored by ``key``: joins and groups on it move no row."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    with _set(spark, CLEAN_SHUFFLES, "true"):
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option(
            "path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def widen(df: DataFrame) -> DataFrame:
    """Spread a small file-backed frame, read as fewer splits than cores, over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, waves: int = 4) -> DataFrame:
    """Fit the partitions of a file-backed frame to the cores that work on them.

    Besides widening a small input, merges a very large one, without a shuffle, to a few waves
    of tasks. Use it where every task returns a partial result of fixed size, so that the
    number of partials follows the cluster and not the data.
    """
    most = waves * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else widen(df)
