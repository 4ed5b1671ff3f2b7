"""Helpers shared by the training-data operators: the shared folder and clash-free columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; the same pattern reads alike in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Files of a table and of a small one, for each core.
FILES = 8, 4
#: Rows and bytes of a batch that goes to a Python worker or comes from one, at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all runs in one
    process (tests). On a cluster a folder of this machine would hold but a part of what is written."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, rows go to Python in batches of bounded size: executors hold each batch outside their heap, in a
    buffer that doubles as it fills, and workers hold it as Arrow, as Python strings and as bytes."""
    before = {key: spark.conf.get(key, None) for key in BATCHES}
    try:
        for key, most in BATCHES.items():
            now = str(before[key] or "").lower()
            if not now.isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system; workers stay between tasks, with all they keep."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The table goes to a few files a core and not to one a partition, a ``small`` one (far smaller than what it is made
    from) to still fewer; a task then makes its partitions one after the other, with the memory of one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.coalesce(max(16, FILES[small] * spark.sparkContext.defaultParallelism)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table written by :func:`materialise`, once nothing will read it again."""
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders(df):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def folders(df: DataFrame) -> set[str]:
    """The folders of the files that a table reads."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null or blank text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, unlike ``lower`` which also folds other scripts."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has, compared without case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
