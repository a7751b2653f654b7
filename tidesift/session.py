"""Session helpers shared by operators and queries."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only while its own size estimate stays under this many bytes.
BROADCAST_LIMIT_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for a table that several jobs read. See drop_scratch."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that shared_path made room for in this process. What was read from them can't be used afterwards,
    so this is for the end of a job."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _scratch:
        path = hadoop.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever file system its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of a DataFrame, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """The same rows with a broadcast hint where their estimated size is within the limit; else unchanged, so that the
    join shuffles."""
    return df.hint("broadcast") if plan_bytes(df) <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least half as many partitions as tasks run at once, for work that is heavier than moving them.

    Only an input too small to fill the cluster is shuffled; one that has the partitions stays where it is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if 2 * df.rdd.getNumPartitions() <= tasks else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once per application, as a zip that Spark distributes."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix != ".pyc":
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
