"""Sinks: split manifest, feature store, metrics, and removal of derived rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.sources.files import is_derived


_made: list[str] = []


def _clean() -> None:
    """Deletes scratch folders when the process ends."""
    spark = SparkSession.getActiveSession()
    for path in _made if spark is not None else ():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the files are scratch
            return


atexit.register(_clean)
_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, deleted at exit: in spark.checkpoint.dir, or where that is unset, on a local master alone, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='spark-cairnwork-', dir='/tmp')}")
        base = _local[0]
    _made.append(f"{base}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def fixed(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a scratch folder: later steps all see the same rows, and lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_split_manifest(df: DataFrame, path: str, form: str = "csv") -> None:
    df.write.mode("overwrite").options(**({"header": True} if form == "csv" else {})).format(form).save(path)


def read_split_manifest(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    return spark.read.options(**({"header": True} if form == "csv" else {})).format(form).schema(schema).load(path)


def save_features(df: DataFrame, path: str, tag: str, names: list[str] | None = None, features: str = "v") -> None:
    """One Parquet table a tag, a folder a split; feature names travel in the column's metadata."""
    if names is not None:
        df = df.withMetadata(features, {"names": names})
    df.write.mode("overwrite").partitionBy(*(["split"] if "split" in df.columns else [])).parquet(f"{path}/{tag}")


def load_features(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{tag}")


def load_or_make(spark: SparkSession, path: str, tag: str, make) -> DataFrame:
    """The stored features, or those of make(), stored first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{tag}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        save_features(make(), path, tag)
    return load_features(spark, path, tag)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON file a model, in a folder of its name, and a table of all under summary."""
    metrics.write.mode("overwrite").partitionBy("model").json(f"{path}/models")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/summary")  # a row a model


def purge_derived(df: DataFrame, stem: str, path: str) -> int:
    """Writes the originals to path; the number of derived rows that went."""
    derived = is_derived(F.col(stem))
    df.where(~derived).write.mode("overwrite").parquet(path)
    return df.where(derived).count()
