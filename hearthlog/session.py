"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans are written for. Subjects are spread over many
# keys, so a window on (household, subject) may feed a join on that pair plus a
# slot without moving rows again.
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A summary row per busy slot grows into every silent slot after it, so small
    # shuffles must keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    # For the same reason a task gets few of them: its rows after the fill, not before,
    # are what it sorts. The number of tasks grows with the input; below 2000 the sizes
    # of partitions are known one by one.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1920",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
    # The JVM does not compile methods above 8000 bytes; smaller stages run faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in TUNING.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A one-machine session for tests and the bench."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("hearthlog")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


# The folder of a one-machine session that names none, removed when it ends.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where tables between phases go: the cluster's own checkpoint folder.

    A folder of its own is used only by a session on one machine that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = folder = tempfile.mkdtemp(prefix="hearthlog-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _OWN[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session's own making, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage is cut, and a lost executor
    costs a re-read rather than a recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
