"""Session helpers: local sessions for tests and bench, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(app: str = "opinara", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and bench runs. On a cluster, use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for staged tables and stream checkpoints, visible to every executor.

    The cluster names the root in ``spark.checkpoint.dir``. A temporary folder is used only by
    a local master, where driver and executors share one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        app_id = sc.applicationId
        if app_id not in _local_dirs:
            _local_dirs[app_id] = tempfile.mkdtemp(prefix="opinara-")
        root = _local_dirs[app_id]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The copy has a measured size: a join with it is a broadcast while it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and a shuffle on the key beyond. It also survives
    lost executors without being computed again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that no later plan reads, whatever executors are lost.

    A frame that `staged` did not return is left alone.
    """
    for table in tables:
        path = _folders.pop(table, None)
        if path:
            delete_folder(table.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared work folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
