"""Intermediate tables in the folder that the whole cluster shares.

``keep`` writes a DataFrame as Parquet below the checkpoint folder and reads it back. The written table cuts the
lineage, survives lost executors and lets several branches of a plan read the same rows.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows stay below this.
BROADCAST_ROWS = 200_000


#: Tables written by ``keep`` and not yet removed, oldest first.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that names none gets a temporary one, any other must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmap-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for what is removed when the driver's process ends, or by ``remove_kept`` before."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(_remove_at_exit)
        atexit.register(_remove_at_exit, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    _written.append(path)
    return path


def _delete(jvm, conf, path: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(conf).delete(path, True)


def _remove_at_exit(jvm, conf) -> None:
    while _written:
        with contextlib.suppress(Exception):  # the JVM may be gone; then the folder's owner clears it
            _delete(jvm, conf, _written.pop())


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a kept table of narrow rows) with a broadcast hint if its row count proves it small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def apart(df: DataFrame, rows: int = BROADCAST_ROWS // 4) -> DataFrame:
    """``df`` (a kept table) as it is if its row count proves it small, else with a hint against broadcasts of its joins.

    Spark judges a table by the bytes of its files. Sorted numbers take far fewer bytes there than in a broadcast, so that a
    table of millions of rows would pass whole through the driver.
    """
    return df if df.count() <= rows else df.hint("merge")


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """``df`` (a table, counted from its files) dealt to tasks of about ``rows`` rows, 32 at least, for much work on each row.

    A file of few bytes is one task, however many rows it has.
    """
    return df.repartition(max(32, -(-df.count() // rows)), *keys)


def kept() -> int:
    """How many tables are kept now; see ``remove_kept``."""
    return len(_written)


def remove_kept(spark: SparkSession, since: int = 0) -> None:
    """Deletes what ``keep`` has written after ``kept()`` gave ``since``. Frames that read these tables can't be used any more."""
    while len(_written) > since:
        _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _written.pop())
