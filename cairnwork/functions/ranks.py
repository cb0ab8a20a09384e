"""Ranks and quantiles in order of a value, without a task that holds a class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.sources import stores

#: Ranges that a group's values, or one of its ranges, are dealt to at once.
RANGES = 64
#: Rows of a range that one window orders; a range of more is dealt to ranges again, while it holds several values.
MOST_ROWS = 1 << 20
#: Deals at most: 64^5 ranges of a group.
LEVELS = 5


def _bounds(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by with __bounds: RANGES - 1 approximate quantiles of each group's rows."""
    return df.groupBy(*by).agg(F.percentile_approx(F.col(x).cast("double"), [k / RANGES for k in range(1, RANGES)], 1000).alias("__bounds"))


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column]]:
    """other with its keys renamed, and the null-safe condition that joins it to df."""
    renamed = other.toDF(*[f"__key_{c}" if c in keys else c for c in other.columns])
    return renamed, [df[c].eqNullSafe(renamed[f"__key_{c}"]) for c in keys]


def _large(ranged: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The ranges that one window shan't order."""
    counts = ranged.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"), (F.min(x) != F.max(x)).alias("__several"))
    return counts.where((F.col("__n") > MOST_ROWS) & F.col("__several")).select(*keys)


def _ranged(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """df with __range, an array of numbers that grows with x: ranges of at most MOST_ROWS rows of a group, or of one value.

    A range (at first a whole group) of more rows is dealt to RANGES by approximate quantiles, and its parts again while
    they are too large. Bounds are fixed before use, in a table that a join reads, so that every later step sees
    the same ones and the driver holds none, whatever the number of groups.
    """
    columns = df.columns
    keys = [*by, "__range"]
    ranged = df.withColumn("__range", F.array().cast("array<int>"))
    for _ in range(LEVELS):
        large = _large(ranged, keys, x)
        if large.isEmpty():
            break
        other, same = _same(ranged, large, keys)
        bounds = stores.fixed(_bounds(ranged.where(F.col(x).isNotNull()).join(other, same, "left_semi"), keys, x), "bounds")
        other, same = _same(ranged, bounds, keys)
        number = F.size(F.filter("__bounds", lambda b: b <= F.col(x).cast("double")))
        deeper = F.when(F.col("__bounds").isNull(), F.col("__range")).otherwise(F.concat("__range", F.array(number)))
        ranged = ranged.join(other, same, "left").select(*columns, deeper.alias("__range"))
    return ranged


def before(df: DataFrame, by: Sequence[str], x: str, out: str, weight: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """df (x not null) with out: the number (or weight) of rows before it in its group, in order of x and the further columns.

    Rows count within (group, range); the sums of the ranges before, at most RANGES a group, come by a join. Rows of one
    value stay together: where values repeat much, collapse them first and give weights.
    """
    by = list(by)
    ranged = _ranged(df, by, x).withColumn("__w", F.lit(1) if weight is None else weight)
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__w").alias("__n"))
    earlier = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*by, "__range").orderBy(x, *order).rowsBetween(W.unboundedPreceding, -1)
    counted = ranged.withColumn("__here", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__range") == F.col("__r")]
    return counted.join(base, same).select(*df.columns, (F.col("__base") + F.col("__here")).alias(out))


def quantiles(df: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """by and the exact quantiles (linear between neighbours) under names; groups without values are absent.

    Values collapse to counts, ranges that hold no wanted rank leave before anything is ordered.
    """
    by = list(by)
    counted = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__c"))
    ranged = _ranged(counted, by, x)
    group = W.partitionBy(*by) if by else W.partitionBy()
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__c").alias("__n"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__n").over(group.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__total", F.sum("__n").over(group))
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(s) * (F.col("__total") - 1)).alias("at")) for k, s in enumerate(shares)])
    wanted = F.filter(places, lambda p: (F.floor(p["at"]) < F.col("__base") + F.col("__n")) & (F.ceil(p["at"]) >= F.col("__base")))
    holding = sums.withColumn("__wanted", wanted).where(F.size("__wanted") > 0).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), "__base", "__wanted")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__range") == F.col("__r")]
    rows = ranged.join(holding, same)
    first = F.col("__base") + F.coalesce(F.sum("__c").over(W.partitionBy(*by, "__range").orderBy(x).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__first", first).withColumn("__p", F.explode("__wanted"))
    holds = lambda at: (F.col("__first") <= at) & (at < F.col("__first") + F.col("__c"))
    low, high = F.floor("__p.at"), F.ceil("__p.at")
    ends = rows.where(holds(low) | holds(high)).groupBy(*by, F.col("__p.k").alias("__k"), F.col("__p.at").alias("__at")).agg(F.max(F.when(holds(low), F.col(x))).alias("__lo"), F.max(F.when(holds(high), F.col(x))).alias("__hi"))
    value = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at"))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("__k") == k, value)).alias(n) for k, n in enumerate(names)])
