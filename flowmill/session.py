"""What jobs need of a session: a folder that driver and executors share, and this package on the executors."""

from __future__ import annotations

import io
import re
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Of each thread: where stored has written tables that are still there, in order. So no thread releases another's.
_own = threading.local()
#: While it is on, what a query has shuffled is deleted when it ends, and not just when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A batch between the JVM and Python; both sides hold some.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Where it names none, a temporary one, which only a local session (a test) can share with its tasks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def place_of(spark: SparkSession, path: str):
    """The file system of path, and its handle there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def until_exit(spark: SparkSession, path: str) -> None:
    """What is at path, an empty folder if there is nothing, goes when the application ends."""
    store, place = place_of(spark, path)
    if not store.exists(place):
        store.mkdirs(place)
    store.deleteOnExit(place)


def tables() -> list[str]:
    """The tables that this thread has stored and that are still there."""
    if not hasattr(_own, "tables"):
        _own.tables = []
    return _own.tables


def write(df: DataFrame, path: str, **options: int | str) -> None:
    """df as Parquet at path. What is shuffled for it is deleted when it is written. Options are those of the Parquet writer."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        conf.set(CLEAN, before)


def stored(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs no work.

    Options are those of the Parquet writer. The table is deleted when the Spark application ends, or by discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path, **options)
    until_exit(spark, path)
    tables().append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for release."""
    return len(tables())


def release(since: int, *used: DataFrame) -> None:
    """Delete the tables that stored has written since a mark, but for those that used still reads."""
    needed = {f.rsplit("/", 2)[1] for df in used for f in df.inputFiles()}
    for path in tables()[since:]:
        if path.rsplit("/", 1)[1] not in needed:
            store, place = place_of(used[0].sparkSession, path)
            store.delete(place, True)
            tables().remove(path)


def discard(table: DataFrame) -> None:
    """Delete a table that stored gave, when nothing will read it any more."""
    names = {f.rsplit("/", 2)[1] for f in table.inputFiles()}
    for path in [p for p in tables() if p.rsplit("/", 1)[1] in names]:
        store, place = place_of(table.sparkSession, path)
        store.delete(place, True)
        tables().remove(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, as --py-files does; and keep the session's Arrow batches small.

    This sets spark.sql.execution.arrow.maxBytesPerBatch in the caller's session, unless the caller has set it.
    """
    if spark.conf.get(BATCH[0]) == "67108864b":  # as it comes; a session's own choice stays
        spark.conf.set(BATCH[0], str(BATCH[1]))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    folder = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}"
    until_exit(spark, folder)
    store, place = place_of(spark, f"{folder}/flowmill.zip")
    out = store.create(place)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(store.makeQualified(place).toString())
    _shipped.add(app)
