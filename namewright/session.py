"""Session helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a query's shuffle files when it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str, int]] = []  # the last is the thread that wrote it


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, as the cluster sets it.

    Only where the setting is absent and the master is local is a temporary
    folder used; a cluster without the setting is an error, since a folder of
    one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="namewright-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The result has no lineage: a lost executor costs the re-reading of files.
    Parquet keeps the copy columnar and compressed, and later scans prune it.
    The files go when the application ends; what was shuffled to write them goes
    at once, since nothing reads it again.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    forget_later(spark, path)
    return path


def forget_later(spark: SparkSession, path: str) -> None:
    """Have discard() delete a file or folder."""
    _written.append((spark, path, threading.get_ident()))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something lies at a path, in whatever store the session reads it from."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what the thread wrote within; results that are still needed must have been read or saved by then."""
    before = {path for _, path, _ in _written}
    try:
        yield
    finally:
        discard(lambda path, thread: path not in before and thread == threading.get_ident())


def discard(which=lambda path, thread: True) -> None:
    """Delete everything cut() wrote, or what is asked for of it; also runs when the driver exits."""
    for entry in [w for w in _written if which(*w[1:])]:
        _written.remove(entry)
        spark, path, _ = entry
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone already
            pass


atexit.register(discard)
