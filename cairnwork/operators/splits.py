"""Splits and samples: exact quotas, whole groups, folds; every choice is by seeded hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.hashing import hashed_rank, order_key, uniform


def class_quota(df: DataFrame, label: str, share: float) -> DataFrame:
    """label and quota: ceil(share * n) rows dealt to classes by largest remainder, ties to the lesser label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = W.partitionBy()  # over classes, a handful of rows
    exact = counts.withColumn("all", F.sum("n").over(total)).withColumn("want", F.ceil(F.round(F.col("all") * share, 9)))
    exact = exact.withColumn("due", F.col("n") * F.col("want") / F.col("all")).withColumn("floor", F.floor("due"))
    rest = exact.withColumn("left", F.col("want") - F.sum("floor").over(total)).withColumn("place", F.row_number().over(W.orderBy((F.round(F.col("due") - F.col("floor"), 9)).desc(), label)))
    return rest.select(label, (F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def stratified_holdout(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split: 'test' for exactly the quota of each class, else 'train'."""
    ranked = hashed_rank(df, [label], order_key(seed, key), "rank_in_class")
    return ranked.join(class_quota(df, label, share), label).withColumn("split", F.when(F.col("rank_in_class") <= F.col("quota"), "test").otherwise("train")).select(*df.columns, "split")


def stratified_three_way(df: DataFrame, label: str, key: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """df with split: test first, then val as val / (1 - test) of the rest, so that val is val of the total."""
    first = stratified_holdout(df, label, key, test, seed)
    rest = first.where("split = 'train'").drop("split")
    second = stratified_holdout(rest, label, key, val / (1 - test), seed + 1)
    return first.where("split = 'test'").unionByName(second.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train")))


def grouped_holdout(df: DataFrame, group: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """df with split; whole groups move. ceil(test * groups) test groups, then ceil(val / (1 - test) * rest) val groups."""
    groups = hashed_rank(df.select(group).distinct(), [], order_key(seed, group), "place")
    n = groups.agg(F.count("*").alias("n"))
    sizes = n.select(F.ceil(F.round(F.col("n") * test, 9)).alias("n_test"), "n").withColumn("n_val", F.ceil(F.round((F.col("n") - F.col("n_test")) * (val / (1 - test)), 9)))
    split = F.when(F.col("place") <= F.col("n_test"), "test").when(F.col("place") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    assigned = groups.crossJoin(F.broadcast(sizes)).select(group, split.alias("split"))  # sizes is one row
    return df.join(assigned, group).select(*df.columns, "split")


def split_distribution(df: DataFrame, split: str, label: str, labels: list) -> DataFrame:
    """Rows per class, a column a class of the given domain, for each split."""
    counted = df.groupBy(split).pivot(label, labels).count()
    return counted.select(split, *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"n_{x}") for x in labels])


def stratified_kfold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return hashed_rank(df, [label], order_key(seed, key), "place").select(*df.columns, F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias("fold"))


def head_n_per_class(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """The first n rows of each class by key; Spark limits groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(label).orderBy(key))).where(F.col("place") <= n)


def cap_sample(df: DataFrame, keys: list[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """n rows without replacement by least hash (all rows where there are fewer): top-n, no full sort."""
    return df.withColumn("__key", order_key(seed, *keys)).orderBy("__key").limit(n).drop("__key")


def stride_downsample(samples: DataFrame, n: int = 8000) -> DataFrame:
    """Every s-th sample of a series, s = max(1, length // n), at most n of them."""
    lengths = samples.groupBy("series_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("s"))  # combined before the shuffle; a row a series joins
    kept = samples.join(lengths, "series_id").where((F.pmod(F.col("t"), F.col("s")) == 0) & (F.floor(F.col("t") / F.col("s")) < n))
    return kept.select(*samples.columns)


def balanced_sampler(df: DataFrame, label: str, key: str, draws: int, seed: int = 42) -> DataFrame:
    """draw, label, key: rows drawn with replacement, every class as likely as any other.

    The range join onto cumulative class weights meets one row a class, a broadcast whose size is the class domain.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    share = 1.0 / F.count("*").over(W.partitionBy())
    upper = F.sum(F.lit(1.0)).over(W.orderBy(label)) * share
    bounds = sizes.select(label, "n", (upper - share).alias("low"), upper.alias("high"))
    spark = df.sparkSession
    u = spark.range(draws).select(F.col("id").alias("draw"), uniform(seed, "id").alias("u"), uniform(seed + 1, "id").alias("v"))
    drawn = u.join(F.broadcast(bounds), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    drawn = drawn.select("draw", label, (F.floor(F.col("v") * F.col("n")) + 1).alias("place"))
    return drawn.join(hashed_rank(df.select(label, key), [label], order_key(seed, key), "place"), [label, "place"]).select("draw", label, key)


def assert_no_leakage(df: DataFrame, group: str, split: str, strict: bool = True) -> DataFrame:
    """a, b, shared: groups that a pair of splits shares; with strict, any raises ValueError."""
    pairs = df.select(group, split).distinct()
    a, b = pairs.select(group, F.col(split).alias("a")), pairs.select(group, F.col(split).alias("b"))
    names = pairs.select(split).distinct()
    every = names.select(F.col(split).alias("a")).join(names.select(F.col(split).alias("b")), F.col("a") < F.col("b"))
    shared = a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    found = every.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))
    if strict and (bad := found.where("shared > 0").take(1)):
        raise ValueError(f"{bad[0].shared} groups are in both {bad[0].a} and {bad[0].b}")
    return found


def ceil_share(n: int, share: float) -> int:
    return math.ceil(round(n * share, 9))


def row_share(column: Column) -> Column:
    return F.avg(column.cast("int"))
