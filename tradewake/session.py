"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; all are runtime SQL settings, so they also apply
# to a session somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # "first n rows of each group" drops rows before the shuffle up to this n;
    # the paged scan keeps 4000 rows per market.
    "spark.sql.optimizer.windowGroupLimitThreshold": "4000",
}


def build_session(app: str = "tradewake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # Recording the Python line of every column expression slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else a folder below the warehouse.

    Both lie on the file system the session shares with its executors.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


# Lists of the stages written inside the scopes that are open; the first holds those outside of any.
_SCOPES: list[list[str]] = [[]]


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the stages that were written inside, once the consumer is done with them.

    Results must be computed within the scope.
    """
    written: list[str] = []
    _SCOPES.append(written)
    try:
        yield
    finally:
        _SCOPES.remove(written)
        delete_paths(spark, written)


def delete_stages(spark: SparkSession) -> None:
    """Deletes all stages written so far outside of scopes; frames that read them can't be computed any more."""
    delete_paths(spark, _SCOPES[0])
    _SCOPES[0].clear()


def _delete_at_exit(spark: SparkSession) -> None:
    try:
        delete_stages(spark)
    except Exception:
        # The gateway may be gone already; the files then stay for whoever clears the shared folder.
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later stages restart from the files when executors are lost, read only the
    columns they need, and see the true size of the table when choosing a join.
    """
    path = scratch_path(df.sparkSession, "stage")
    if not _SCOPES[0]:
        atexit.unregister(_delete_at_exit)
        atexit.register(_delete_at_exit, df.sparkSession)
    _SCOPES[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
