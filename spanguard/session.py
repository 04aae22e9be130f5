"""Session helpers: settings for large inputs, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for a cluster; adaptive execution coalesces and splits the many shuffle partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def builder(app: str = "spanguard") -> SparkSession.Builder:
    return SparkSession.builder.appName(app).config(map=SETTINGS)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master, as in tests, a folder of its own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder there that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanguard-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that nothing above is computed twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a folder in a store that Spark reads when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


#: Tables whose rows hold whole texts, which take far more time to search than to send.
TEXTS = ("documents", "pages", "conversations")
#: Tables of narrow rows from each of which texts are made and searched, and how many of them a task takes.
MADE = ("customer",)
ROWS = 1 << 17


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it has fewer partitions than there are: a file of one row group is one task.

    Large tables have more partitions and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else dealt(df, ROWS) if name in MADE else df


def dealt(df: DataFrame, per_task: int) -> DataFrame:
    """df, dealt evenly over tasks of about `per_task` rows, and over all cores at least.

    For few or narrow columns whose rows take much work or become many: Spark cuts files by their bytes, so such a
    table is one task, or a few, however many rows it has.
    """
    return df.repartition(tasks(df, per_task))


def tasks(df: DataFrame, per_task: int) -> int:
    """How many tasks of `per_task` rows df makes, at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // per_task))
