"""What the training-data operators share: work folders, checked broadcasts, word rules."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else None
    if not found:
        found = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = f"file://{found}"
    return found.rstrip("/")


class Work:
    """Tables written to the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
        """Write and read again; ``by`` names a column of few values that gets a folder per value."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(at, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unhinted (a shuffled join follows)."""
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df


def release_memory() -> None:
    """Give freed memory of this Python worker back to the system; executors share theirs between JVM and workers."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of the contracts; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _murmur3(number: int, seed: int = 42) -> int:
    """The hash by which Spark deals rows by one int column."""
    mask = 0xFFFFFFFF
    k = number * 0xCC9E2D51 & mask
    k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
    h = seed ^ k
    h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def seat(number: Column, tasks: int) -> Column:
    """A key for ``repartition(tasks, key)`` that puts rows with ``number`` n into partition n modulo ``tasks``.

    Hashing few numbers would leave some partitions without any and others with several.
    """
    found: dict[int, int] = {}
    k = 0
    while len(found) < tasks:
        found.setdefault(_murmur3(k) % tasks, k)
        k += 1
    table = F.array(*[F.lit(found[t]) for t in range(tasks)]) if tasks <= 4096 else None
    if table is None:  # with so many, hashing is even enough
        return number.cast("int")
    return F.element_at(table, (number % tasks).cast("int") + 1)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
