"""Queries of metrics and comparisons, over nearest-centroid predictions of held-out embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.operators import fusion, metrics
from cairnwork.plans.base import HOLDOUT, features, holdout, query, table

#: Feature positions (from, to) of the models that are compared.
MODELS = {"all": (0, 64), "first": (0, 16), "second": (16, 32)}


def scored(rows: DataFrame, train: DataFrame, low: int = 0, high: int = 64) -> DataFrame:
    """rows with scores and classes of a centroid model on features low..high-1."""
    cut = lambda df: df.withColumn("v", F.slice("v", low + 1, high - low))
    return fusion.centroid_scores(cut(rows), fusion.centroids(cut(train)))


def predictions(spark, d, low: int = 0, high: int = 64) -> DataFrame:
    """vec_id, truth, pred of the test rows."""
    held = holdout(spark, d)
    return fusion.predicted(scored(held.where("split = 'test'"), held.where("split = 'train'"), low, high)).select("vec_id", F.col("label").alias("truth"), "pred")


def by_model(spark, d) -> DataFrame:
    """model, vec_id, truth, pred of all models in one pass: a slice of the centroids is the centroid of the slice."""
    held = holdout(spark, d)
    whole = fusion.centroids(held.where("split = 'train'"))
    rows = held.where("split = 'test'").crossJoin(F.broadcast(whole.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("model"))))  # one row

    def best(low: int, high: int):
        scores = F.transform("model", lambda m: -A.squared_distance(F.slice("v", low + 1, high - low), F.slice(m["centre"], low + 1, high - low)))
        return F.element_at(F.transform("model", lambda m: m["label"]), (A.argmax(scores) + 1).cast("int"))

    preds = F.array(*[F.struct(F.lit(m).alias("model"), best(*span).alias("pred")) for m, span in MODELS.items()])
    return rows.select("vec_id", F.col("label").alias("truth"), F.explode(preds).alias("p")).select("p.model", "vec_id", "truth", "p.pred")


def domain(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("idx")).distinct()


DISTANCES = HOLDOUT + """,
centres AS (SELECT l.label AS class, k, avg(x) AS m FROM long l JOIN held h USING (vec_id) WHERE split = 'train' GROUP BY ALL),
models(model, lo, hi) AS (VALUES ('all', 0, 64), ('first', 0, 16), ('second', 16, 32)),
dist AS (SELECT model, l.vec_id, l.label AS truth, class, sum((x - m) * (x - m)) AS d2 FROM long l JOIN held h USING (vec_id) JOIN centres USING (k) JOIN models ON k >= lo AND k < hi WHERE split = 'test' GROUP BY ALL)"""
PREDICTED = DISTANCES + """,
preds AS (SELECT model, vec_id, truth, class AS pred FROM dist QUALIFY row_number() OVER (PARTITION BY model, vec_id ORDER BY d2, class) = 1),
p AS (SELECT * FROM preds WHERE model = 'all')"""
CLASSES = "dom AS (SELECT DISTINCT label AS class FROM embeddings)"
REPORT = CLASSES + """,
rep AS (SELECT model, dom.class, count(*) FILTER (truth = dom.class AND pred = dom.class) AS tp, count(*) FILTER (truth = dom.class) AS support, count(*) FILTER (pred = dom.class) AS predicted FROM preds, dom GROUP BY ALL),
full_rep AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS prec, coalesce(tp / nullif(support, 0), 0) AS rec, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1 FROM rep),
f1s AS (SELECT model, avg(f1) AS macro_f1, avg(f1) FILTER (support + predicted > 0) AS observed_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM full_rep GROUP BY model),
acc AS (SELECT model, avg((truth = pred)::INT) AS accuracy FROM preds GROUP BY model),
marg AS (SELECT model, sum(support) AS s, sum(tp) AS c, sum(support * predicted) AS pt, sum(predicted * predicted) AS pp, sum(support * support) AS tt FROM rep GROUP BY model),
mk AS (SELECT model, coalesce((c * s - pt) / nullif(sqrt((s * s - pp)::DOUBLE * (s * s - tt)::DOUBLE), 0), 0) AS mcc, coalesce((c / s - pt / (s * s)) / nullif(1 - pt / (s * s), 0), 0) AS kappa FROM marg)"""


@query("confusion_matrix", f"WITH {PREDICTED}, {CLASSES}, g AS (SELECT a.class AS truth, b.class AS pred FROM dom a, dom b), n AS (SELECT g.truth, g.pred, count(vec_id) AS n FROM g LEFT JOIN p USING (truth, pred) GROUP BY ALL) SELECT truth, pred, n, round(n / greatest(sum(n) OVER (PARTITION BY truth), 1), 6) AS share FROM n")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(predictions(spark, d), domain(spark, d)).withColumn("share", F.round("share", 6))


@query("per_class_report", f"WITH {PREDICTED}, {REPORT} SELECT class, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM full_rep WHERE model = 'all'")
def per_class_report(spark, d):
    found = metrics.per_class_report(predictions(spark, d), domain=domain(spark, d))
    return found.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("accuracy_f1", f"WITH {PREDICTED}, {REPORT} SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(observed_f1, 6) AS observed_f1, round(weighted_f1, 6) AS weighted_f1 FROM acc JOIN f1s USING (model) WHERE model = 'all'")
def accuracy_f1(spark, d):
    found = metrics.accuracy_f1(predictions(spark, d), domain=domain(spark, d))
    return found.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "observed_f1", "weighted_f1")])


@query("mcc", f"WITH {PREDICTED}, {REPORT} SELECT model, round(mcc, 6) AS mcc FROM mk")
def mcc(spark, d):
    return metrics.mcc(by_model(spark, d), ["model"]).withColumn("mcc", F.round("mcc", 6))


@query("cohen_kappa", f"WITH {PREDICTED}, {REPORT} SELECT model, round(kappa, 6) AS kappa FROM mk")
def cohen_kappa(spark, d):
    return metrics.cohen_kappa(by_model(spark, d), ["model"]).withColumn("kappa", F.round("kappa", 6))


@query("auc_ovr_macro", f"""WITH {DISTANCES}, s AS (SELECT truth, class, -round(d2, 1) AS score FROM dist WHERE model = 'all'),
r AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS rk FROM s),
a AS (SELECT class, sum(rk) FILTER (truth = class) AS ranks, (count(*) FILTER (truth = class))::DOUBLE AS p, (count(*) FILTER (truth <> class))::DOUBLE AS q FROM r GROUP BY class)
SELECT round(avg((ranks - p * (p + 1) / 2) / (p * q)), 6) AS auc FROM a""")
def auc_ovr_macro(spark, d):
    held = holdout(spark, d)
    s = scored(held.where("split = 'test'"), held.where("split = 'train'"))
    long = s.select(F.col("label").alias("truth"), F.explode(F.arrays_zip("classes", "scores")).alias("z")).select("truth", F.col("z.classes").alias("class"), F.round("z.scores", 1).alias("score"))
    return metrics.auc_ovr_macro(long).withColumn("auc", F.round("auc", 6))


METRICS = f"{PREDICTED}, {REPORT}, every AS (SELECT model, accuracy, macro_f1, weighted_f1, mcc, kappa FROM acc JOIN f1s USING (model) JOIN mk USING (model))"


@query("model_comparison", f"WITH {METRICS} SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(mcc, 6) AS mcc, round(kappa, 6) AS kappa, row_number() OVER (ORDER BY round(macro_f1, 6) DESC, model) = 1 AS best FROM every")
def model_comparison(spark, d):
    found = metrics.evaluate(by_model(spark, d), ["model"], domain(spark, d))
    found = found.select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "mcc", "kappa")])
    return metrics.model_comparison(found, "model")


@query("ablation_table", f"WITH {METRICS}, o AS (SELECT model AS variant, round(macro_f1, 6) AS macro_f1 FROM every) SELECT variant, macro_f1, round(macro_f1 - 0.2703, 6) AS delta, row_number() OVER (ORDER BY macro_f1 DESC, variant)::INT AS place, row_number() OVER (ORDER BY macro_f1 DESC, variant) = 1 AS best FROM o")
def ablation_table(spark, d):
    f1 = metrics.accuracy_f1(by_model(spark, d), ["model"], domain(spark, d)).select(F.col("model").alias("variant"), F.round("macro_f1", 6).alias("macro_f1"))
    return metrics.ablation_table(f1, 0.2703).withColumn("delta", F.round("delta", 6))


@query("three_way_comparison", f"WITH {METRICS} SELECT CASE model WHEN 'first' THEN 'A' WHEN 'second' THEN 'B' ELSE 'C' END AS slot, model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM every")
def three_way_comparison(spark, d):
    found = metrics.accuracy_f1(by_model(spark, d), ["model"], domain(spark, d))
    slot = F.when(F.col("model") == "first", "A").when(F.col("model") == "second", "B").otherwise("C")
    return found.select(slot.alias("slot"), "model", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("early_stop_log", """WITH log AS (SELECT row_number() OVER (ORDER BY day) - 1 AS epoch, score FROM (SELECT date_trunc('day', ts) AS day, round(avg(value), 4) AS score FROM events GROUP BY 1)),
a AS (SELECT *, score > coalesce(max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved, max(score) OVER (ORDER BY epoch) AS best FROM log),
b AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS best_epoch FROM a),
c AS (SELECT *, epoch - best_epoch AS waited FROM b)
SELECT epoch, score, improved, best, best_epoch, waited, waited >= 8 AND coalesce(max(waited) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 8 AS stop FROM c""")
def early_stop_log(spark, d):
    from pyspark.sql import Window as W

    daily = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("score"))
    log = daily.select((F.row_number().over(W.orderBy("day")) - 1).cast("long").alias("epoch"), "score")  # a row a day
    return metrics.early_stop_log(log).select("epoch", "score", "improved", "best", "best_epoch", "waited", "stop")


LEAK = HOLDOUT + """,
centres AS (SELECT protocol, l.label AS class, k, avg(x) AS m FROM long l JOIN held h USING (vec_id), (VALUES ('leak_free'), ('leaky')) v(protocol) WHERE split = 'train' OR protocol = 'leaky' GROUP BY ALL),
dist AS (SELECT protocol, l.vec_id, l.label AS truth, class, sum((x - m) * (x - m)) AS d2 FROM long l JOIN held h USING (vec_id) JOIN centres USING (k) WHERE split = 'test' GROUP BY ALL),
preds AS (SELECT protocol AS model, vec_id, truth, class AS pred FROM dist QUALIFY row_number() OVER (PARTITION BY protocol, vec_id ORDER BY d2, class) = 1)"""


@query("leak_report", f"WITH {LEAK}, {REPORT}, w AS (SELECT max(macro_f1) FILTER (model = 'leaky') AS a, max(macro_f1) FILTER (model = 'leak_free') AS b FROM f1s) SELECT 'centroid' AS model, round(a, 6) AS leaky_f1, round(b, 6) AS leak_free_f1, round(100 * (a - b) / a, 4) AS drop_percent FROM w")
def leak_report(spark, d):
    held = holdout(spark, d)
    test = held.where("split = 'test'")
    rows = [fusion.predicted(scored(test, train)).select(F.lit(name).alias("model"), F.col("label").alias("truth"), "pred") for name, train in (("leak_free", held.where("split = 'train'")), ("leaky", held))]
    f1 = metrics.accuracy_f1(rows[0].unionByName(rows[1]), ["model"], domain(spark, d))
    w = f1.agg(F.max(F.when(F.col("model") == "leaky", F.col("macro_f1"))).alias("a"), F.max(F.when(F.col("model") == "leak_free", F.col("macro_f1"))).alias("b"))
    return w.select(F.lit("centroid").alias("model"), F.round("a", 6).alias("leaky_f1"), F.round("b", 6).alias("leak_free_f1"), F.round(100 * (F.col("a") - F.col("b")) / F.col("a"), 4).alias("drop_percent"))


SOFTMAX = f"WITH {DISTANCES}, s AS (SELECT vec_id, class, -d2 AS z, max(-d2) OVER (PARTITION BY vec_id) AS top FROM dist WHERE model = 'first'), e AS (SELECT *, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY vec_id) AS p FROM s)"


def softmaxed(spark, d):
    held = holdout(spark, d)
    return scored(held.where("split = 'test'"), held.where("split = 'train'"), 0, 16).withColumn("p", A.softmax(F.col("scores")))


@query("softmax_proba", f"{SOFTMAX} SELECT vec_id, class, round(p, 6) AS proba FROM e")
def softmax_proba(spark, d):
    return softmaxed(spark, d).select("vec_id", F.explode(F.arrays_zip("classes", "p")).alias("z")).select("vec_id", F.col("z.classes").alias("class"), F.round("z.p", 6).alias("proba"))


@query("argmax_label", f"{SOFTMAX} SELECT vec_id, round(max(p), 6) AS top_proba, arg_max(class, p) AS pred FROM e GROUP BY vec_id")
def argmax_label(spark, d):
    return softmaxed(spark, d).select("vec_id", F.round(F.array_max("p"), 6).alias("top_proba"), F.element_at("classes", (A.argmax(F.col("p")) + 1).cast("int")).alias("pred"))
