"""Evaluation tables: confusion matrix, per-class report, scalar metrics, comparisons.

Predictions are (model?, truth, pred); every function takes the columns to group by (none, or a model name).
Only sums of small integers pass the shuffle: predictions collapse to counts per (truth, pred) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.ranks import before


def counts(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    return predictions.groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def confusion_matrix(predictions: DataFrame, domain: DataFrame) -> DataFrame:
    """truth, pred, n, share of the truth's row, for every pair of the domain (idx)."""
    grid = domain.select(F.col("idx").alias("truth")).crossJoin(domain.select(F.col("idx").alias("pred")))  # classes squared
    full = grid.join(counts(predictions), ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(W.partitionBy("truth")), F.lit(1)))


def per_class_report(predictions: DataFrame, by: list[str] = (), domain: DataFrame | None = None) -> DataFrame:
    """by, class, precision, recall, f1, support; classes of the domain, or those in truth or prediction."""
    by = list(by)
    c = counts(predictions, by)
    right = c.where("truth = pred").select(*by, F.col("truth").alias("class"), F.col("n").alias("tp"))
    truth = c.groupBy(*by, F.col("truth").alias("class")).agg(F.sum("n").alias("support"))
    predicted = c.groupBy(*by, F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    if domain is None:
        classes = truth.select(*by, "class").union(predicted.select(*by, "class")).distinct()
    else:
        classes = domain.select(F.col("idx").alias("class"))
        classes = c.select(*by).distinct().crossJoin(classes).select(*by, "class") if by else classes
    key = [*by, "class"]
    full = classes.join(truth, key, "left").join(predicted, key, "left").join(right, key, "left").fillna(0, ["tp", "support", "predicted"])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return full.select(*key, precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def _sums(predictions: DataFrame, by: list[str], domain: DataFrame | None) -> DataFrame:
    """by, s (rows), c (right), pt, pp, tt (sums of products over classes), f1, wf1, seen (observed classes), k (classes to average over).

    One pass: counts per (truth, pred), two rows of a count per class, then sums.
    """
    by = list(by)
    zero = F.lit(0).cast("long")
    right = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    two = F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), zero.alias("p"), right.alias("c")), F.struct(F.col("pred").alias("class"), zero.alias("t"), F.col("n").alias("p"), zero.alias("c")))
    per = counts(predictions, by).select(*by, F.explode(two).alias("x")).select(*by, "x.*").groupBy(*by, "class").agg(*[F.sum(x).cast("double").alias(x) for x in "tpc"])
    f1 = ratio(2 * F.col("c"), F.col("p") + F.col("t"))
    sums = per.groupBy(*by).agg(F.sum("t").alias("s"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("p")).alias("pt"), F.sum(F.col("p") ** 2).alias("pp"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(f1).alias("f1"), F.sum(f1 * F.col("t")).alias("wf1"), F.count("*").cast("double").alias("seen"))
    if domain is None:
        return sums.withColumn("k", F.col("seen"))
    return sums.crossJoin(domain.agg(F.countDistinct("idx").cast("double").alias("k")))  # one row; absent classes count 0


def accuracy_f1(predictions: DataFrame, by: list[str] = (), domain: DataFrame | None = None) -> DataFrame:
    """by, accuracy, macro_f1, observed_f1, weighted_f1; macro over the domain, observed over labels in truth or prediction."""
    s = _sums(predictions, by, domain)
    return s.select(*by, (F.col("c") / F.col("s")).alias("accuracy"), (F.col("f1") / F.col("k")).alias("macro_f1"), (F.col("f1") / F.col("seen")).alias("observed_f1"), (F.col("wf1") / F.col("s")).alias("weighted_f1"))


def mcc(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    """Multiclass Matthews correlation, 0 where a side is constant."""
    m = _sums(predictions, by, None)
    below = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return m.select(*by, ratio(F.col("c") * F.col("s") - F.col("pt"), below).alias("mcc"))


def cohen_kappa(predictions: DataFrame, by: list[str] = ()) -> DataFrame:
    m = _sums(predictions, by, None)
    expected = F.col("pt") / F.col("s") ** 2
    return m.select(*by, ratio(F.col("c") / F.col("s") - expected, 1 - expected).alias("kappa"))


def auc_ovr_macro(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """scores (by, truth, class, score): mean one-vs-rest AUC with average ranks for ties; null if a class lacks positives or negatives.

    Rows collapse to counts per distinct score first; the counts before each give the ranks, summed by ranges of scores.
    """
    by = list(by)
    per = scores.groupBy(*by, "class", "score").agg(F.count("*").alias("n"), F.sum((F.col("truth") == F.col("class")).cast("long")).alias("pos"))
    ranked = before(per, [*by, "class"], "score", "below", F.col("n")).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    auc = ranked.groupBy(*by, "class").agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    auc = auc.withColumn("auc", F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))))
    return auc.groupBy(*by).agg(F.when(F.count("*") == F.count("auc"), F.avg("auc")).alias("auc"))


def evaluate(predictions: DataFrame, by: list[str], domain: DataFrame | None = None) -> DataFrame:
    """by and all scalar metrics of labels, from one pass."""
    expected = F.col("pt") / F.col("s") ** 2
    below = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return _sums(predictions, by, domain).select(
        *by, (F.col("c") / F.col("s")).alias("accuracy"), (F.col("f1") / F.col("k")).alias("macro_f1"), (F.col("wf1") / F.col("s")).alias("weighted_f1"),
        ratio(F.col("c") * F.col("s") - F.col("pt"), below).alias("mcc"), ratio(F.col("c") / F.col("s") - expected, 1 - expected).alias("kappa"),
    )


def model_comparison(metrics: DataFrame, order: str = "place") -> DataFrame:
    """metrics with best: the row of the greatest macro_f1, the first of equals in `order`. One row a model."""
    return metrics.withColumn("best", F.row_number().over(W.orderBy(F.col("macro_f1").desc(), order)) == 1)


def ablation_table(metrics: DataFrame, baseline: float) -> DataFrame:
    """variant, macro_f1, delta to the baseline, place by macro_f1, best. One row a variant."""
    by_f1 = W.orderBy(F.col("macro_f1").desc(), "variant")
    return metrics.select("variant", "macro_f1", (F.col("macro_f1") - baseline).alias("delta"), F.row_number().over(by_f1).alias("place")).withColumn("best", F.col("place") == 1)


def early_stop_log(log: DataFrame, patience: int = 8) -> DataFrame:
    """log (epoch, score) with best so far, improved (strictly), waited epochs, stop. One row an epoch."""
    before = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    log = log.withColumn("improved", F.col("score") > F.coalesce(F.max("score").over(before), F.lit(float("-inf"))))
    log = log.withColumn("best_epoch", F.max(F.when(F.col("improved"), F.col("epoch"))).over(so_far)).withColumn("best", F.max("score").over(so_far))
    log = log.withColumn("waited", F.col("epoch") - F.col("best_epoch"))
    return log.withColumn("stop", (F.col("waited") >= patience) & (F.coalesce(F.max("waited").over(before), F.lit(0)) < patience))
