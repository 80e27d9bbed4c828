"""Session settings and the shared folder for lineage cuts and written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "duelbook", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="duelbook-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the driver's process ends."""
    if not _MADE:
        atexit.register(_clean)
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/duelbook/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _MADE if spark else []:
        try:
            remove_path(spark, path)
        except Exception:  # the session is going down: what is left is the folder owner's to delete
            return


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table of a run that is no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Spark deletes a query's shuffle files at its end; otherwise they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: for a result that is written, and so not computed from them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read files instead of recomputing the plan."""
    shared_dir(df.sparkSession)
    with _released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own: ``df`` may be read again


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written as compressed columns: later steps read the columns they need. Order and layout are not kept; see ``cut``."""
    path = scratch_path(df.sparkSession, label)
    with _released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned and nothing reads any more; others are left alone."""
    for table in tables:
        path = table.__dict__.get("_stored_at")
        if path in _MADE:
            _MADE.remove(path)
            remove_path(table.sparkSession, path)
