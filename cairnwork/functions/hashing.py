"""Seeded, repeatable order and uniforms from md5: the same on any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_key(seed: int | str, *columns: str | Column) -> Column:
    """32 hexadecimal digits that order rows at random for this seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def uniform(seed: int | str, *columns: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits."""
    return F.conv(F.substring(order_key(seed, *columns), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Leading hexadecimal digits that make the buckets of hashed_rank: 16^3 of them.
BUCKET_DIGITS = 3


def hashed_rank(df: DataFrame, by: list[str], key: Column, out: str) -> DataFrame:
    """df with the rank (from 1) of each row within `by` in order of key, an order_key().

    A class may hold most rows, so that no task ranks a class: rows rank within (class, key's first digits), and the
    counts of the buckets before, at most 4096 a class, come by a join.
    """
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    counts = keyed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1) if by else W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = keyed.withColumn("__row", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy("__key")))
    joined = ranked.join(base, [*by, "__bucket"])
    return joined.select(*df.columns, (F.col("__base") + F.col("__row")).alias(out))
