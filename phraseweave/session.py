"""Session settings for one machine; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes of input for a task of a step that holds its rows in memory, and the most tasks of such a step.
PART_BYTES, MOST_PARTS = 8 << 20, 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; without one a session on one machine gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="phraseweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, where: str):
    """The file system and the path of an address."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the session's JVM ends."""
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    files, path = hadoop_path(spark, where)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def stored(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and not again when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that costs far more than moving them: a file of one row group is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def parts_of(*frames: DataFrame) -> int:
    """How many tasks should share a step over these rows, by the stored size of what they are read from: a task then holds no more of a large input than of a small one.

    A number of shuffle partitions that is fixed, or joined up by compressed size, lets a task's rows grow with the input or with how well they compress.
    """
    spark, size = frames[0].sparkSession, 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRDD":  # its size isn't known
                return int(spark.conf.get("spark.sql.shuffle.partitions"))
            size += int(str(leaf.stats().sizeInBytes()))
    return min(max(size // PART_BYTES + 1, spark.sparkContext.defaultParallelism), MOST_PARTS)


def local_session(name: str = "phraseweave", cpus: int | None = None, memory: str = "6g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
