"""Nearest-centroid models, stacking of their probabilities, and weighted blends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A


def centroids(train: DataFrame, label: str = "label", features: str = "v") -> DataFrame:
    """label and centre (array): means per class and position, combined before the shuffle."""
    long = train.select(label, F.posexplode(features).alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("m"))
    return long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))


def centroid_scores(rows: DataFrame, centres: DataFrame, label: str = "label", features: str = "v") -> DataFrame:
    """rows with scores: minus the squared distance to each class, classes in order. centres is a row a class."""
    model = centres.agg(F.array_sort(F.collect_list(F.struct(label, "centre"))).alias("model"))
    scored = rows.crossJoin(F.broadcast(model))  # one row: classes x features numbers
    return scored.withColumn("scores", F.transform("model", lambda m: -A.squared_distance(F.col(features), m["centre"]))).withColumn("classes", F.transform("model", lambda m: m[label])).drop("model")


def predicted(scored: DataFrame) -> DataFrame:
    """scored with pred: the class of the first greatest score."""
    return scored.withColumn("pred", F.element_at("classes", (A.argmax(F.col("scores")) + 1).cast("int")))


def stack_features(rows: DataFrame, probabilities: DataFrame, models: list[str], key: str, classes: int) -> DataFrame:
    """key, stacked: the models' probability vectors in order; a model without a row for a key gives zeros."""
    wide = probabilities.groupBy(key).pivot("model", models).agg(F.first("proba"))
    zeros = F.array_repeat(F.lit(0.0), classes)
    return rows.select(key).join(wide, key, "left").select(key, F.concat(*[F.coalesce(F.col(f"`{m}`"), zeros) for m in models]).alias("stacked"))


def blend_grid(n_ml: int = 2) -> list[tuple[int, float, list[float]]]:
    """(place, network weight, model weights) of the search, as floating-point steps make it: the network's weights 0.3 to
    0.9 by 0.1; the first model's weights from 0 by rest / n_ml while below rest + 0.05; the others share what is left."""
    grid = []
    for i in range(7):
        w = 0.3 + 0.1 * i
        rest = 1.0 - w
        step = rest / n_ml
        k = 0
        while k * step < rest + 0.05:
            first = k * step
            grid.append((len(grid), round(w, 6), [round(first, 6)] + [round(rest - first, 6)] * (n_ml - 1)))
            k += 1
    return grid


def weighted_blend(rows: DataFrame, weights: list[float], columns: list[str]) -> DataFrame:
    """rows with blend: the weighted sum of the probability columns, and its argmax."""
    total = A.scaled(F.col(columns[0]), weights[0])
    for c, w in zip(columns[1:], weights[1:], strict=True):
        total = A.added(total, A.scaled(F.col(c), w))
    return rows.withColumn("blend", total).withColumn("pred", A.argmax(F.col("blend")))


def first_best(scores: DataFrame) -> DataFrame:
    """The first row in order of place among those of the greatest macro_f1. scores is a row a grid point."""
    return scores.withColumn("r", F.row_number().over(W.orderBy(F.col("macro_f1").desc(), "place"))).where("r = 1").drop("r")
