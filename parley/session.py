"""Session helpers: shared scratch space, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a side is left to the optimiser's own (size-checked) choice.
BROADCAST_ROWS = 2_000_000

_local_scratch: str | None = None
_scopes: list[list[str]] = []


def local_session(cores: int | str = 8, app: str = "parley", **conf) -> SparkSession:
    """A session for tests and bench runs on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a folder of this machine is used, and only if all
    of Spark runs in this one process; anywhere else that is an error.
    """
    global _local_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="parley-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nobody has used yet."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for names in _scopes:
        names.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is put into the shared folder inside is removed on leaving: write the result before.

    with scratch_scope(spark):
        flow(spark).write.parquet(path)
    """
    names: list[str] = []
    _scopes.append(names)
    try:
        yield
    finally:
        _scopes.remove(names)
        for name in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run inside go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on its inputs: a lost executor re-reads files
    instead of re-running (and perhaps re-partitioning) what came before.
    """
    path = scratch_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` gave and that nothing reads any more: all that came of them is stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread the rows when a scan has fewer tasks than there are cores.

    A corpus of any size has more file splits than the cluster has cores and goes
    through unchanged; one small file is otherwise worked on by a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when the caller can prove at most ``max_rows`` rows.

    Beyond the limit no hint is given, and the join is planned from sizes.
    """
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df
