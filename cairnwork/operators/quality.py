"""Data quality: non-finite values, silence, lengths, rows to set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonfinite_audit(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """by, feature, n_nan, n_inf: one pass over all columns, unpivoted after the aggregation."""
    sums = [F.sum(F.isnan(c).cast("long")).alias(f"nan_{c}") for c in columns] + [F.sum((F.abs(F.col(c)) == float("inf")).cast("long")).alias(f"inf_{c}") for c in columns]
    found = df.groupBy(*by).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(f"nan_{c}", F.lit(0)).alias("n_nan"), F.coalesce(f"inf_{c}", F.lit(0)).alias("n_inf")) for c in columns]))
    return found.select(*by, rows.alias("r")).select(*by, "r.*")


def series_rms(samples: DataFrame, by: list[str] = ("series_id",)) -> DataFrame:
    return samples.groupBy(*by).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def silence_filter(samples: DataFrame, threshold: float = 0.001) -> DataFrame:
    """series_id, rms, silent."""
    return series_rms(samples).withColumn("silent", F.col("rms") < threshold)


def length_audit(df: DataFrame, length: str, target: int) -> DataFrame:
    """One row: counts and percentages of rows that would be padded, truncated, or fit."""
    n = F.col(length)
    kinds = {"padded": n < target, "truncated": n > target, "exact": n == target}
    counted = df.agg(F.count(length).alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in kinds.items()])
    return counted.select("n", *kinds, *[F.round(100 * F.col(k) / F.col("n"), 4).alias(f"{k}_percent") for k in kinds])


def quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); a null condition rejects."""
    flag = F.coalesce(bad, F.lit(True))
    return df.where(~flag), df.where(flag)


def on_error(df: DataFrame, bad: Column, columns: list[str], policy: str) -> DataFrame:
    """policy 'drop' leaves bad rows out; 'zero' keeps them with 0 in the columns."""
    if policy not in ("drop", "zero"):
        raise ValueError("policy is 'drop' or 'zero'")
    flag = F.coalesce(bad, F.lit(True))
    if policy == "drop":
        return df.where(~flag)
    return df.withColumns({c: F.when(flag, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns})
