"""Helpers shared by the training-data operators: durable intermediate tables and Arrow access."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.sources.shipping import ship

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one, on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-cairnwork-", dir="/tmp"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairnwork/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that store() wrote, through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_stored: list[str] = []


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _stored:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the files are scratch
            return


atexit.register(_clean)


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def scratch(path: str) -> None:
    """Names a folder to be deleted when the process ends."""
    _stored.append(path)


def mark() -> int:
    """Stands for the tables stored so far; see release()."""
    return len(_stored)


def release(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes the tables stored after mark() was taken, but for those to keep. Only when nothing lazy still reads them."""
    for path in [p for p in _stored[since:] if p not in keep]:
        drop_path(spark, path)
        _stored.remove(path)


def give_back() -> None:
    """Returns to the system what this process has freed; allocators keep it otherwise, and a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc; numpy's arrays are there
        trim(0)


def text_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
