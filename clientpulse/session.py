"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ADVISORY_CONF = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# What a task reads of a shuffle while a table is stored, and the partitions
# that leave room for it. Compressed rows take some ten times as much in sorts and aggregates.
TASK_BYTES = 16 << 20
LEAST_PARTITIONS = 200
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def build_session(app: str = "clientpulse", **conf: str) -> SparkSession:
    """A session with the settings every job relies on. Master, memory and
    shuffle parallelism stay with ``spark-submit`` unless passed in ``conf``."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application: their Python
    workers need it for functions that tasks run, and a cluster has it on the driver only."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():
        return  # imported from an archive, which was shipped by whoever made it
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def pin_time_zone(spark: SparkSession) -> None:
    """Date and timestamp boundaries agree only in one fixed session zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def side_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` on the same cluster and shared folder. Observations stay with
    the session that made them, and one that has any cannot be sent to tasks, as the
    training summary of a fitted model tries to; so they get a session of their own."""
    side = spark.newSession()
    pin_time_zone(side)
    return side


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary folder is used only by a local
    master, where the driver and the executors are the same machine, and goes with it."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if spark.sparkContext.applicationId in _own_dirs:
        return _own_dirs[spark.sparkContext.applicationId]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _own_dirs[spark.sparkContext.applicationId] = folder
    return folder


def release(spark: SparkSession) -> None:
    """Delete the tables that this package wrote to the shared folder; for the end of a
    session's work, as results may still read them before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/clientpulse")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def in_bytes(size: str) -> int:
    """The bytes of a size setting, such as 64MB; a plain number is bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Inside, adaptive execution leaves tasks that fit in the memory of a small executor,
    so that sorts and aggregates of a wide plan are not spilled. Smaller sizes and more
    partitions that the session asks for stay, and its settings come back."""
    before = {key: spark.conf.get(key, None) for key in (ADVISORY_CONF, INITIAL_CONF)}
    partitions = int(before[INITIAL_CONF] or spark.conf.get("spark.sql.shuffle.partitions"))
    size = TASK_BYTES if before[ADVISORY_CONF] is None else min(in_bytes(before[ADVISORY_CONF]), TASK_BYTES)
    spark.conf.set(ADVISORY_CONF, f"{size}b")
    spark.conf.set(INITIAL_CONF, str(max(partitions, LEAST_PARTITIONS)))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stable(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. Columns that
    partition the table have to be its last ones.

    Used where a frame feeds several passes: the later passes read columns of a
    stored table, and a lost executor costs a file read, not a rebuild."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/clientpulse/{uuid.uuid4().hex}"
    with small_tasks(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
