"""Scaling fitted on train rows, and softmax pooling over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(train: DataFrame, features: str = "v") -> DataFrame:
    """One row: means and population standard deviations (0 becomes 1) per array position."""
    long = train.select(F.posexplode(features).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = F.array_sort(F.collect_list(F.struct("k", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))))
    return long.agg(row.alias("scaler"))


def standardize(df: DataFrame, scaler: DataFrame, features: str = "v") -> DataFrame:
    """df with features scaled; the scaler is one row, a broadcast whose size is the number of features."""
    scaled = F.zip_with(features, "scaler", lambda x, s: (x - s["m"]) / s["s"])
    return df.crossJoin(F.broadcast(scaler)).withColumn(features, scaled).drop("scaler")


def band_normalize(bands: DataFrame, is_train: Column) -> DataFrame:
    """bands (series_id, frame, band, db) with z: less the band's mean over rows and frames of train, over its deviation + 1e-8."""
    stats = bands.where(is_train).groupBy("band").agg(F.avg("db").alias("m"), F.stddev_pop("db").alias("s"))
    return bands.join(F.broadcast(stats), "band").select("series_id", "frame", "band", ((F.col("db") - F.col("m")) / (F.col("s") + 1e-8)).alias("z"))  # a row a band


def attention_weights(samples: DataFrame, score: Column) -> DataFrame:
    """samples with weight: the softmax of score over the series. Two aggregates by series join back, no series is held."""
    scored = samples.withColumn("__s", score)
    top = scored.groupBy("series_id").agg(F.max("__s").alias("__top"))
    raised = scored.join(top, "series_id").withColumn("__e", F.exp(F.col("__s") - F.col("__top")))
    total = raised.groupBy("series_id").agg(F.sum("__e").alias("__total"))
    return raised.join(total, "series_id").select(*samples.columns, (F.col("__e") / F.col("__total")).alias("weight"))
