"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, so that they need no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="textloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(name)
    sc._textloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """The table in as many partitions as there are cores, where its scan has fewer than that.

    A scan makes a partition of each ``spark.sql.files.maxPartitionBytes``, so fewer partitions
    than cores are less data than that a core: too little to matter where it moves, but work on
    its texts would leave cores idle. Larger tables stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; on a cluster
    a machine-local folder would not be seen by the executors, so that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_ROOTS: list[tuple[SparkSession, str]] = []


def clear_workspaces() -> None:
    """Deletes the tables of all workspaces; what was made of them can't be read any more. The end of the program does so by itself."""
    while _ROOTS:
        spark, root = _ROOTS.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # noqa: BLE001, S110
            pass  # the JVM is gone, or the folder


atexit.register(clear_workspaces)


class Workspace:
    """Tables written to the shared folder, to cut lineage and survive lost executors; deleted when the program ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/textloom-{label}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append((spark, self.root))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
