"""Sessions, the shared folder, and intermediate tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master that names no folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/loomdoc"


def get_spark(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomdoc")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder; a local one only for a
    local master. A cluster without any is an error, as its machines share no folder that could be guessed."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_SHARED
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: nothing can be removed through it any more
        pass


def written(df: DataFrame, label: str, *by: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, in folders by columns, and read it back: cuts the lineage and survives lost executors.

    files: at most so many are written, however many partitions df has. Hadoop's local file system, where its native library is
    missing, starts a process from the executor's JVM for each file and folder that it makes.
    """
    path = new_folder(df.sparkSession, label)
    df = df.coalesce(files) if files else df
    schema = df.schema
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes below df: file sizes for tables, so it follows the input without a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def file_count(df: DataFrame, file_bytes: int = 4 << 20, most: int = 1 << 20) -> int:
    """Files for a table of no more bytes than df has: one for each file_bytes, but two for each core and 8 at least."""
    return max(8, 2 * df.sparkSession.sparkContext.defaultParallelism, min(most, plan_bytes(df) // file_bytes))
