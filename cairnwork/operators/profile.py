"""Profiles: distributions, summaries, histograms, correlation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.ranks import quantiles
from cairnwork.sources.shipping import ship

QUARTILES = ("q25", "q50", "q75")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """label, n, percent, imbalance (greatest class : this class); classes without rows are absent."""
    whole = W.partitionBy()  # a row a class
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    return counted.select(label, "n", (100 * F.col("n") / F.sum("n").over(whole)).alias("percent"), (F.max("n").over(whole) / F.col("n")).alias("imbalance"))


def describe_by_group(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """count, mean, std (ddof 1), min, quartiles (linear), max."""
    whole = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_quartiles(whole, df, by, x).select(*by, "n", "mean", "std", "min", *QUARTILES, "max")


def with_quartiles(whole: DataFrame, df: DataFrame, by: list[str], x: str) -> DataFrame:
    """whole (a row a group) with the exact quartiles of x in df; null where a group has no values."""
    q = quantiles(df, by, x, (0.25, 0.5, 0.75), QUARTILES)
    if not by:
        return whole.join(q, how="left")  # a row each
    q = q.toDF(*[f"__{c}" for c in by], *QUARTILES)
    same = [whole[c].eqNullSafe(q[f"__{c}"]) for c in by]
    return whole.join(q, same, "left").drop(*[f"__{c}" for c in by])


def feature_summary_topk(long: DataFrame, k: int = 10) -> DataFrame:
    """The k features (column k of long) of greatest standard deviation, with cv = std / max(|mean|, 1e-10)."""
    s = long.groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return s.withColumn("cv", F.col("std") / F.greatest(F.abs("mean"), F.lit(1e-10))).orderBy(F.col("std").desc(), "k").limit(k)


def energy_stats(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def five_number_summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Quartiles, and whiskers: the farthest values within 1.5 interquartile ranges of the box."""
    box = quantiles(df, by, x, (0.25, 0.5, 0.75), QUARTILES)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = df.join(F.broadcast(box) if not by else box, by) if by else df.crossJoin(box)
    inside = inside.where((F.col(x) >= F.col("q25") - reach) & (F.col(x) <= F.col("q75") + reach))
    return inside.groupBy(*by, "q25", "q50", "q75").agg(F.min(x).alias("low"), F.max(x).alias("high"))


def histogram_bins(df: DataFrame, x: str, bins: int) -> DataFrame:
    """bin, low, high, n, density; equal width from least to greatest, the last bin closed. Empty bins are listed."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("total"))
    placed = df.select(x).where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends))  # ends is one row
    width = (F.col("hi") - F.col("lo")) / bins
    placed = placed.select(F.least(F.floor((F.col(x) - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(ends)
    n = F.coalesce("n", F.lit(0))
    return grid.join(placed.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), n.alias("n"), (n / (F.col("total") * width)).alias("density"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def distinct_per_class(df: DataFrame, label: str, column: str) -> DataFrame:
    """label, values (sorted, joined by commas), n; distinct pairs first, so that no task gathers rows."""
    pairs = df.groupBy(label, column).agg(F.count("*").alias("n"))
    return pairs.groupBy(label).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias("values"), F.sum("n").alias("n"))


def group_size_stats(df: DataFrame, group: str) -> DataFrame:
    """One row: groups, and the least, greatest and median rows of a group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.min("n").alias("min"), F.max("n").alias("max"), F.percentile("n", 0.5).alias("median"))


MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all pairs of positions in a batch of arrays: number of rows that have both, means, and sums of squares and products about them."""
    for batch in batches:
        column = batch.column(0).drop_null()
        if not len(column):
            continue
        sizes = column.value_lengths().to_numpy()
        x = np.full((len(column), int(sizes.max())), np.nan)
        x[np.arange(x.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        has = ~np.isnan(x)
        shift = np.where(has.any(0), np.nansum(x, 0) / np.maximum(has.sum(0), 1), 0.0)
        x, has = np.where(has, x - shift, 0.0), has.astype(float)
        n = has.T @ has
        with np.errstate(invalid="ignore", divide="ignore"):
            mx, my = x.T @ has / n, has.T @ x / n
            xx, yy, xy = (x * x).T @ has - n * mx * mx, has.T @ (x * x) - n * my * my, x.T @ x - n * mx * my
        i, j = np.nonzero(n)
        values = (n, mx + shift[:, None], my + shift[None, :], xx, yy, xy)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v[i, j]) for v in values)], names=["i", "j", *MOMENTS])


def correlation_matrix(df: DataFrame, features: str = "v", upper: bool = False) -> DataFrame:
    """i, j, r (Pearson) of all pairs of array positions; upper: i < j alone; null without spread.

    A task makes one matrix of moments a batch; a row a pair and batch goes on, not a row a pair and input row.
    """
    ship(df.sparkSession)
    found = df.select(F.col(features).cast("array<double>").alias("v")).mapInArrow(_moments, "i int, j int, " + ", ".join(f"{c} double" for c in MOMENTS))
    if upper:
        found = found.where("i < j")
    n, x, y = F.sum("n"), F.sum(F.expr("n * mx")), F.sum(F.expr("n * my"))
    xx = F.sum(F.expr("cxx + n * mx * mx")) - x * x / n
    yy = F.sum(F.expr("cyy + n * my * my")) - y * y / n
    xy = F.sum(F.expr("cxy + n * mx * my")) - x * y / n
    return found.groupBy("i", "j").agg(xx.alias("xx"), yy.alias("yy"), xy.alias("xy")).select("i", "j", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))


def correlated_pairs(df: DataFrame, features: str = "v", k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row: mean and max |r|, counts above 0.8 and 0.9; the k pairs of greatest |r|)."""
    r = correlation_matrix(df, features, upper=True).withColumn("size", F.abs("r"))
    summary = r.agg(F.avg("size").alias("mean_abs"), F.max("size").alias("max_abs"), F.sum((F.col("size") > 0.8).cast("long")).alias("above_80"), F.sum((F.col("size") > 0.9).cast("long")).alias("above_90"))
    return summary, r.orderBy(F.col("size").desc(), "i", "j").limit(k).drop("size")


def interclass_variance_topk(long: DataFrame, label: str = "label", k: int = 10) -> DataFrame:
    means = long.groupBy(label, "k").agg(F.avg("x").alias("m"))
    return means.groupBy("k").agg(F.var_samp("m").alias("variance")).orderBy(F.col("variance").desc(), "k").limit(k)


def reindex_fill(means: DataFrame, domain: DataFrame, label: str, value: str) -> DataFrame:
    """A row per label of the domain; 0 where there is none."""
    return domain.join(means, label, "left").select(label, F.coalesce(value, F.lit(0.0)).alias(value))
