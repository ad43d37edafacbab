"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one on a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lectern-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """While it lasts, shuffle files go as soon as the job that wrote them has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    Later jobs read the table, so a lost executor costs nothing of what is behind it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(array: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string array."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def chunks(rows: Iterator, weigh, limit: int) -> Iterator[list]:
    """Lists of consecutive rows of about ``limit`` weight in all; a heavier row is alone in its list."""
    held, total = [], 0
    for row in rows:
        w = weigh(row)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(row)
        total += w
    if held:
        yield held


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
