"""Session settings and the shared folder in which stage results are kept."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "tessera", master: str | None = None, partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Stage tables must outlive any one executor, so on a cluster the setting is
    required. Only a ``local`` master gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL_DIRS[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:12]}")


#: Spark removes a query's shuffle files when it ends, not when the driver's collector happens on them.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A task that writes by partition keeps a file of each open, up to so many, and sorts its rows (on disk, if they are many) only beyond that.
_OPEN_FILES = ("spark.sql.maxConcurrentOutputFileWriters", "16")


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


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends: for writes, whose rows are read from the files written."""
    with _set(spark, _DROP_SHUFFLES, "true"), _set(spark, *_OPEN_FILES):
        yield


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    This cuts the lineage, survives executor loss, keeps a cascade from running
    its earlier stages twice, and gives the optimizer a true size, so that a
    later equi-join is broadcast only when Spark's own size threshold allows it.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.mode("overwrite").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows
