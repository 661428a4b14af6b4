"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, shuffle_partitions: int = 8, scan_pieces: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster use the session the cluster provides: nothing in this library
    depends on the settings made here.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldtally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if scan_pieces:
        builder = builder.config("fieldtally.scanPieces", str(scan_pieces))
    return builder.getOrCreate()


def reusable(df: DataFrame) -> DataFrame:
    """Materialise a frame that several jobs will read.

    Where the session names a checkpoint folder the frame is written there, so
    the loss of an executor costs a read and not a recomputation. Elsewhere it
    is persisted, and lost blocks are rebuilt from the sources.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scratch_folder(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder name for intermediate tables that driver and executors share.

    It lies where the session's ``spark.checkpoint.dir`` says. Only a session on a single
    machine, as in tests, gets a folder of its own where none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldtally-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
