"""Rebalancing: plans of derived rows, mixing, synthetic neighbours, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.hashing import hashed_rank, order_key, uniform
from cairnwork.functions.ranks import before
from cairnwork.operators import neighbours

# Names of the waveform transforms, in the order in which plans use them.
TRANSFORMS = (
    "noise_low", "noise_high", "stretch_slow", "stretch_fast", "pitch_up", "pitch_down", "shift_left", "shift_right", "gain_up",
    "gain_down", "bandpass", "reverb", "combo_noise_pitch", "combo_noise_stretch", "combo_shift_noise", "combo_pitch_stretch", "combo_gain_noise",
)
ROUND_ROBIN_TRANSFORMS = ("noise", "shift", "stretch", "pitch", "reverb", "background")


#: Rows of either side that one task compares at a time; pivots of a class at most.
CHUNK_ROWS, MOST_PIVOTS = 2048, 256


def _ranked(df: DataFrame, label: str, key: str) -> DataFrame:
    """label, key, rank (from 1) in order of a numeric key."""
    return before(df.select(label, key), [label], key, "rank").withColumn("rank", F.col("rank") + 1)


def _slots(needs: DataFrame, label: str) -> DataFrame:
    """label, n and i from 0 to need - 1: one range of numbers for all classes, whose limits (a row a class) are known to the driver."""
    rows = [r for r in needs.select(label, "n", "need").collect() if r["need"] > 0]
    spark, ends = needs.sparkSession, [0]
    for r in rows:
        ends.append(ends[-1] + int(r["need"]))
    kind = needs.schema[label].dataType.simpleString()
    classes = spark.createDataFrame([(r[label], int(r["n"]), k, ends[k]) for k, r in enumerate(rows)], f"`{label}` {kind}, n long, __k int, __start long")
    number = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends[1:]]), lambda e: e <= F.col("id"))) if rows else F.lit(0)
    return spark.range(ends[-1]).withColumn("__k", number).join(F.broadcast(classes), "__k").select(label, "n", (F.col("id") - F.col("__start")).alias("i"))


def _needs(df: DataFrame, label: str, target: int, dominant=None) -> DataFrame:
    """label, n, need: rows missing to the target; none for the dominant class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(target) - F.col("n"), F.lit(0))
    return counts.select(label, "n", (need if dominant is None else F.when(F.col(label) == dominant, 0).otherwise(need)).alias("need"))


def _first(df: DataFrame, label: str, key: str, needs: DataFrame, most: Column) -> DataFrame:
    """The originals that plans use, ranked by key: at most `most` a class, a bounded number, whatever the class holds."""
    limits = needs.withColumn("most", most)
    ranked = df.join(F.broadcast(limits), label)  # a row a class
    return _ranked(ranked.where("need > 0"), label, key).join(F.broadcast(limits), label).where(F.col("rank") <= F.col("most"))


def augment_plan_major(df: DataFrame, label: str, key: str, target: int = 300, dominant=None, transforms: tuple[str, ...] = TRANSFORMS, cycles: bool = True) -> DataFrame:
    """label, i (from 0), parent, transform: all transforms of an original, then the next original.

    With cycles the originals come again until the need is met; without, a class ends after one pass. Each class's
    need is known first, so that only need rows are made.
    """
    k = len(transforms)
    needs = _needs(df, label, target, dominant)
    if not cycles:
        needs = needs.withColumn("need", F.least("need", F.col("n") * k))
    originals = _first(df, label, key, needs, F.least(F.col("n"), F.ceil(F.col("need") / k)))
    slots = _slots(needs, label)
    slots = slots.withColumn("rank", F.pmod(F.floor(F.col("i") / k), F.col("n")) + 1).withColumn("transform", F.get(F.array(*map(F.lit, transforms)), F.pmod("i", F.lit(k))))
    return slots.join(originals.select(label, "rank", F.col(key).alias("parent")), [label, "rank"]).select(label, "i", "parent", "transform")


def augment_plan_single_pass(df: DataFrame, label: str, key: str, target: int = 300, dominant=None) -> DataFrame:
    return augment_plan_major(df, label, key, target, dominant, cycles=False)


def augment_plan_round_robin(df: DataFrame, label: str, key: str, target: int = 384, seed: int = 42, transforms: tuple[str, ...] = ROUND_ROBIN_TRANSFORMS) -> DataFrame:
    """label, i, parent, transforms: the i-th derived row uses original i mod n, and 2 or 3 transforms by hash."""
    needs = _needs(df, label, target)
    originals = _first(df, label, key, needs, F.least(F.col("n"), F.col("need")))
    slots = _slots(needs, label)
    slots = slots.withColumn("rank", F.pmod("i", F.col("n")) + 1)
    planned = slots.join(originals.select(label, "rank", F.col(key).alias("parent")), [label, "rank"])
    order = F.array_sort(F.array(*[F.struct(order_key(seed, label, "i", F.lit(t)).alias("h"), F.lit(t).alias("t")) for t in transforms]))
    many = F.when(uniform(seed, label, "i", F.lit("count")) < 0.5, 2).otherwise(3)
    return planned.select(label, "i", "parent", F.array_join(F.transform(F.slice(order, F.lit(1), many), lambda s: s["t"]), "+").alias("transforms"))


def mixup(df: DataFrame, key: str, features: str, label: str, weight: float, seed: int = 42) -> DataFrame:
    """key, partner, label_a, label_b, mixed: each row and the row that a seeded permutation gives it."""
    left = hashed_rank(df.select(key, features, label), [], order_key(seed, key), "place")
    right = hashed_rank(df.select(F.col(key).alias("partner"), F.col(features).alias("other"), F.col(label).alias("label_b")), [], order_key(seed + 1, "partner"), "place")
    mixed = F.zip_with(features, "other", lambda a, b: a * weight + b * (1 - weight))
    return left.join(right, "place").select(key, "partner", F.col(label).alias("label_a"), "label_b", mixed.alias("mixed"))


def nearest(df: DataFrame, key: str, features: str, label: str, k: int = 3, chunk: int = CHUNK_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """label, key, neighbour, d2, r: the k nearest rows of the same class, exactly; ties to the lesser key.

    See operators.neighbours: parts around pivots, triangle bounds, blocks of at most about `chunk` rows on either side.
    """
    return neighbours.nearest(df, key, features, label, k, chunk, most_pivots)


def smote(df: DataFrame, key: str, features: str, label: str, k: int = 3, seed: int = 42, target: int | None = None, within: str | None = None) -> DataFrame:
    """label, i, base, neighbour, u, synthetic: rows of minority classes up to the greatest class (or target).

    base rows take turns; neighbour and u come from hashes. A class of one row has no neighbour and stays as it is.
    within: a column that the label determines (a fold); the greatest class is the one of the same value.
    """
    groups = [within] if within else []
    counts = df.groupBy(label, *groups).agg(F.count("*").alias("n"))
    most = F.max("n").over(W.partitionBy(*groups)) if target is None else F.lit(target)
    needs = counts.withColumn("need", most - F.col("n")).where("need > 0 AND n > 1").select(label, "n", "need")
    small = df.join(F.broadcast(needs.select(label)), label, "left_semi")
    slots = _slots(needs, label)
    pick = F.floor(uniform(seed, label, "i") * F.least(F.lit(k), F.col("n") - 1)) + 1
    slots = slots.select(label, "i", (F.pmod("i", F.col("n")) + 1).alias("rank"), pick.alias("r"), uniform(seed + 1, label, "i").alias("u"))
    ranked = _ranked(small, label, key).withColumnRenamed(key, "base")
    near = nearest(small, key, features, label, k).withColumnRenamed(key, "base")
    planned = slots.join(ranked, [label, "rank"]).join(near, [label, "base", "r"])
    rows = df.select(label, F.col(key).alias("base"), F.col(features).alias("x"))
    others = df.select(label, F.col(key).alias("neighbour"), F.col(features).alias("y"))
    made = F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a))
    return planned.join(rows, [label, "base"]).join(others, [label, "neighbour"]).select(label, "i", "base", "neighbour", "u", made.alias("synthetic"))


def class_weights(df: DataFrame, label: str, classes: list | None = None) -> DataFrame:
    """label, n, weight = rows / (classes * max(n, 1)); classes names the domain, absent ones included."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    if classes is not None:
        counts = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} {df.schema[label].dataType.simpleString()}").join(counts, label, "left").fillna(0, ["n"])
    whole = W.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(whole) / (F.count("*").over(whole) * F.greatest("n", F.lit(1)))).alias("weight"))


def ldam_margins(df: DataFrame, label: str, most: float = 0.5) -> DataFrame:
    """label, margin: n^(-1/4), scaled so that the greatest is `most`."""
    counts = df.groupBy(label).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    raw = F.pow("n", F.lit(-0.25))
    return counts.select(label, (raw * most / F.max(raw).over(W.partitionBy())).alias("margin"))


def effective_number_weights(df: DataFrame, label: str, beta: float = 0.9999, epochs: DataFrame | None = None, start: int = 60) -> DataFrame:
    """label, weight = (1 - beta) / (1 - beta^n), scaled to sum to the number of classes; with epochs 1 before start."""
    counts = df.groupBy(label).agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    raw = (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    whole = W.partitionBy()
    weights = counts.select(label, (raw * F.count("*").over(whole) / F.sum(raw).over(whole)).alias("weight"))
    if epochs is None:
        return weights
    return epochs.crossJoin(weights).select("epoch", label, F.when(F.col("epoch") < start, 1.0).otherwise(F.col("weight")).alias("weight"))  # epochs x classes


def leak_rate(df: DataFrame, parent: str, split: str) -> DataFrame:
    """One row: derived rows in test whose parent (or a sibling) is in train, and their share."""
    train = df.where(F.col(split) == "train").select(parent).distinct()
    test = df.where(F.col(split) == "test")
    seen = test.join(train.withColumn("seen", F.lit(1)), parent, "left")
    return seen.agg(F.count("*").alias("test_rows"), F.count("seen").alias("leaked"), F.avg(F.coalesce("seen", F.lit(0)).cast("double")).alias("leak_rate"))
