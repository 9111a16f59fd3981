"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(
    app_name: str = "ledgerloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, UTC time and checkpoint clean-up."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        settings["spark.driver.memory"] = driver_memory
    if master and master.startswith("local"):
        settings["spark.driver.host"] = "127.0.0.1"
        settings["spark.driver.bindAddress"] = "127.0.0.1"
        settings["spark.ui.enabled"] = "false"
    settings.update(extra or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local-mode session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    current = context.getCheckpointDir()
    if not configured and current:
        return current.rsplit("/", 1)[0]
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="ledgerloom-")
    if not current:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}/{label}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind: without this they stay until the driver collects its garbage.

    For writes, batches of streams, and results that are read once: they plan their rows anew, so nobody else
    reads these files.
    """
    before = spark.conf.get(FREE_KEY, None)
    spark.conf.set(FREE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_KEY)
        else:
            spark.conf.set(FREE_KEY, before)


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back."""
    return store(df, scratch_path(df.sparkSession, label), codec)


def store(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a columnar table at ``path`` and read it back."""
    spark = df.sparkSession
    with shuffles_freed(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``store`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
