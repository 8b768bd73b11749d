"""Sessions, table reading, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
_LOCAL_FALLBACK = os.path.join(tempfile.gettempdir(), "paperloom-shared")


def local_session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paperloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a session on one machine may go without that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _LOCAL_FALLBACK


_written: list[tuple[SparkSession, str]] = []
_registered: list[bool] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is
    above, and a DataFrame used several times is computed once.  The folder is
    removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/paperloom/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if not _registered:
        atexit.register(_clean)
        _registered.append(True)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch():
    """Tables written inside are removed at the end of the block; for long drivers, such as streams."""
    before = len(_written)
    try:
        yield
    finally:
        _remove(_written[before:])
        del _written[before:]


def _clean() -> None:
    _remove(_written)


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    for spark, path in written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is already gone
            pass


def small_rows(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` if there are at most ``most``, else None.

    The guard for everything that is sent to all executors: callers must have
    another way for None.
    """
    rows = df.limit(most + 1).collect()
    return None if len(rows) > most else rows
