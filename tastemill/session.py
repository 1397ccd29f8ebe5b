"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

ADVISORY = "16MB"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Before a table is read only its compressed size is known, and repeated vectors pack several hundred
    # times; so files above 1 MB are shuffled, and then broadcast if the rows as they are come to 10 MB.
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Narrow rows of ids take about twenty times their shuffled bytes while a task sorts or groups them.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ADVISORY,
    # What a job has shuffled goes once it has ended; else it stays until the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# The text operators' tables hold few repeated vectors.
TEXT_SETTINGS = {k: v for k, v in SETTINGS.items() if v != ADVISORY} | {"spark.sql.autoBroadcastJoinThreshold": "10MB"}


def tune(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    """Switch on the adaptive features and the bounds of broadcasts every job here counts on."""
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that has
    none gets a temporary folder; on a cluster a machine-local folder would be lost
    with its executor, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tastemill-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tastemill-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage of iterative jobs so that a lost executor costs a re-read
    and not a re-run, and gives the planner real sizes for its broadcast decisions.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_slices(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Write parts of a table one after another, as ``stage`` does, and read them back as one.

    What a part has shuffled goes before the next begins, so the disk holds one part's shuffles.
    """
    path = None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Drop the files behind a staged loop step that a later step has replaced."""
    spark = df.sparkSession
    root = staging_root(spark)
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if root.split(":", 1)[-1] in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
