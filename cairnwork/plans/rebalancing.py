"""Queries of rebalancing and series transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.operators import rebalance, splits, transforms
from cairnwork.plans.base import CENTRED, LABELLED, centred, features, labelled, query, quota_sql
from cairnwork.plans.splitting import U32

T = list(rebalance.TRANSFORMS)
R = list(rebalance.ROUND_ROBIN_TRANSFORMS)


def major_sql(source: str, label: str, key: str, target: int, cycles: bool) -> str:
    need = f"greatest({target} - n, 0)" if cycles else f"least(greatest({target} - n, 0), n * 17)"
    return f"""mn AS (SELECT {label}, count(*) AS n FROM {source} GROUP BY 1), mneed AS (SELECT {label}, n, {need} AS need FROM mn),
mslots AS (SELECT {label}, n, unnest(range(need::BIGINT)) AS i FROM mneed WHERE need > 0),
mrank AS (SELECT {label}, {key} AS parent, row_number() OVER (PARTITION BY {label} ORDER BY {key}) AS rk FROM {source}),
plan AS (SELECT {label}, i::INT AS i, parent, ({T})[i % 17 + 1] AS transform FROM mslots JOIN mrank USING ({label}) WHERE rk = (i // 17) % n + 1)"""


@query("augment_plan_major", f"WITH {LABELLED}, {major_sql('labelled', 'quality', 'doc_id', 3000, True)} SELECT quality, i, parent, transform FROM plan")
def augment_plan_major(spark, d):
    return rebalance.augment_plan_major(labelled(spark, d), "quality", "doc_id", 3000)


@query("augment_plan_single_pass", f"WITH {LABELLED}, {major_sql('labelled', 'quality', 'doc_id', 3000, False)} SELECT quality, i, parent, transform FROM plan")
def augment_plan_single_pass(spark, d):
    return rebalance.augment_plan_single_pass(labelled(spark, d), "quality", "doc_id", 3000)


@query("augment_plan_round_robin", f"""WITH {LABELLED}, n AS (SELECT toxic, count(*) AS n FROM labelled GROUP BY 1),
slots AS (SELECT toxic, n, unnest(range(greatest(384 - n, 0)))::INT AS i FROM n),
rk AS (SELECT toxic, doc_id AS parent, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rk FROM labelled),
p AS (SELECT s.toxic, i, parent FROM slots s JOIN rk ON rk.toxic = s.toxic AND rk.rk = i % n + 1),
o AS (SELECT toxic, i, parent, t, row_number() OVER (PARTITION BY toxic, i ORDER BY md5('42|' || toxic || '|' || i || '|' || t)) AS r, CASE WHEN {U32.format("'42|' || toxic || '|' || i || '|count'")} < 0.5 THEN 2 ELSE 3 END AS many FROM p, (SELECT unnest({R}) AS t))
SELECT toxic, i, parent, string_agg(t, '+' ORDER BY r) AS transforms FROM o WHERE r <= many GROUP BY ALL""")
def augment_plan_round_robin(spark, d):
    return rebalance.augment_plan_round_robin(labelled(spark, d), "toxic", "doc_id")


@query("split_then_augment", f"""WITH {LABELLED},
{quota_sql('labelled', 'quality', 'doc_id', '0.2', 42, 'held')}, train AS (SELECT * FROM held WHERE split = 'train'), {major_sql('train', 'quality', 'doc_id', 500, True)},
wrong AS (SELECT doc_id AS parent, doc_id || '' AS id, quality FROM labelled UNION ALL SELECT doc_id, doc_id || '_aug_1', quality FROM labelled),
{quota_sql('wrong', 'quality', 'id', '0.2', 42, 'leaky')},
w AS (SELECT count(*) AS test_rows, count(*) FILTER (parent IN (SELECT parent FROM leaky WHERE split = 'train')) AS leaked FROM leaky WHERE split = 'test')
SELECT 'split_first' AS protocol, (SELECT count(*) FROM held WHERE split = 'test') AS test_rows, (SELECT count(*) FROM held h JOIN plan ON plan.parent = h.doc_id WHERE h.split = 'test') AS leaked, 0.0::DOUBLE AS leak_rate UNION ALL SELECT 'derive_first', test_rows, leaked, round(leaked / test_rows, 6) FROM w""")
def split_then_augment(spark, d):
    """Derived rows follow the split (the right order) and precede it (the negative control)."""
    rows = labelled(spark, d)
    held = splits.stratified_holdout(rows, "quality", "doc_id")
    plan = rebalance.augment_plan_major(held.where("split = 'train'"), "quality", "doc_id", 500)
    right = held.select(F.col("doc_id").alias("parent"), "split").unionByName(plan.select("parent", F.lit("train").alias("split")))
    doubled = rows.select(F.col("doc_id").alias("parent"), F.col("doc_id").cast("string").alias("id"), "quality").unionByName(rows.select(F.col("doc_id").alias("parent"), F.concat(F.col("doc_id").cast("string"), F.lit("_aug_1")).alias("id"), "quality"))
    wrong = splits.stratified_holdout(doubled, "quality", "id")
    both = rebalance.leak_rate(right, "parent", "split").withColumn("protocol", F.lit("split_first")).unionByName(rebalance.leak_rate(wrong, "parent", "split").withColumn("protocol", F.lit("derive_first")))
    return both.select("protocol", "test_rows", "leaked", F.round("leak_rate", 6).alias("leak_rate"))


NOISE = "sqrt(-2 * ln(1 - {0})) * cos(2 * pi() * {1})".format(U32.format("'42a|' || series_id || '|' || t"), U32.format("'42b|' || series_id || '|' || t"))


@query("add_noise", f"WITH {CENTRED} SELECT series_id, t, round(x + 0.005 * {NOISE}, 7) AS y FROM centred")
def add_noise(spark, d):
    return centred(spark, d).select("series_id", "t", F.round(transforms.add_noise(F.col("x"), 0.005), 7).alias("y"))


@query("add_noise_snr", f"WITH {CENTRED}, n AS (SELECT *, {NOISE} AS e FROM centred), y AS (SELECT *, e * sqrt(avg(x * x) OVER (PARTITION BY series_id) / (avg(e * e) OVER (PARTITION BY series_id) * 10)) AS s FROM n) SELECT series_id, round(10 * log10(avg(x * x) / avg(s * s)), 6) AS snr_db FROM y GROUP BY 1")
def add_noise_snr(spark, d):
    """series_id and the ratio reached, in dB."""
    noisy = transforms.add_noise_snr(centred(spark, d), 10.0)
    e = F.col("y") - F.col("x")
    return noisy.groupBy("series_id").agg(F.round(10 * F.log10(F.avg(F.col("x") * F.col("x")) / F.avg(e * e)), 6).alias("snr_db"))


@query("time_shift", f"WITH {CENTRED} SELECT series_id, t, coalesce(lag(x, 5) OVER (PARTITION BY series_id ORDER BY t), 0) AS later, coalesce(lead(x, 5) OVER (PARTITION BY series_id ORDER BY t), 0) AS earlier FROM centred")
def time_shift(spark, d):
    return transforms.shifted(centred(spark, d), {"later": 5, "earlier": -5}).select("series_id", "t", "later", "earlier")


@query("random_gain", f"WITH {CENTRED} SELECT series_id, t, round(x * power(10.0::DOUBLE, (-6 + 12 * {U32.format("'42|' || series_id")}) / 20), 4) AS x FROM centred")
def random_gain(spark, d):
    return centred(spark, d).select("series_id", "t", F.round(transforms.random_gain(F.col("x")), 4).alias("x"))


IMPULSE = [1.0, 0.5, 0.25, 0.125]


@query("fir_convolve", f"WITH {CENTRED}, h AS (SELECT unnest(range(4)) AS k, unnest({IMPULSE})::DOUBLE AS h), y AS (SELECT s.series_id, s.t + k AS t, sum(x * h) AS y FROM centred s, h GROUP BY ALL) SELECT c.series_id, c.t, round(0.7 * x + 0.3 * y, 8) AS x FROM centred c JOIN y USING (series_id, t)")
def fir_convolve(spark, d):
    return transforms.fir_convolve(centred(spark, d), IMPULSE, 0.3).select("series_id", "t", F.round("x", 8).alias("x"))


@query("compose_transforms", f"WITH {CENTRED} SELECT series_id, t, round(-coalesce(lag(x, 4) OVER (PARTITION BY series_id ORDER BY t), 0) * power(10, 0.3::DOUBLE), 4) + 0.0 AS x FROM centred")
def compose_transforms(spark, d):
    return transforms.compose(centred(spark, d), ["shift_right", "gain_up", "flip"]).select("series_id", "t", (F.round("x", 4) + F.lit(0.0)).alias("x"))


@query("mixup", "WITH a AS (SELECT vec_id, label AS label_a, embedding, row_number() OVER (ORDER BY md5('42|' || vec_id)) AS place FROM embeddings), b AS (SELECT vec_id AS partner, label AS label_b, embedding AS other, row_number() OVER (ORDER BY md5('43|' || vec_id)) AS place FROM embeddings) SELECT vec_id, partner, label_a, label_b, round(embedding[1]::DOUBLE * 0.3 + other[1]::DOUBLE * 0.7, 6) AS first, round(embedding[64]::DOUBLE * 0.3 + other[64]::DOUBLE * 0.7, 6) AS last FROM a JOIN b USING (place)")
def mixup(spark, d):
    m = rebalance.mixup(features(spark, d), "vec_id", "v", "label", 0.3)
    return m.select("vec_id", "partner", "label_a", "label_b", F.round(F.col("mixed")[0], 6).alias("first"), F.round(F.col("mixed")[63], 6).alias("last"))


@query("smote", f"""WITH l AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), needs AS (SELECT label, n, max(n) OVER () - n AS need FROM c),
slots AS (SELECT label, n, unnest(range(need))::INT AS i FROM needs WHERE need > 0 AND n > 1),
s AS (SELECT label, i, i % n + 1 AS rk, floor({U32.format("'42|' || label || '|' || i")} * least(3, n - 1))::BIGINT + 1 AS r, {U32.format("'43|' || label || '|' || i")} AS u FROM slots),
ranked AS (SELECT label, vec_id AS base, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rk FROM embeddings),
dist AS (SELECT a.label, a.vec_id AS base, b.vec_id AS neighbour, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM l a JOIN l b ON a.label = b.label AND a.k = b.k AND a.vec_id <> b.vec_id GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY label, base ORDER BY d2, neighbour) AS r FROM dist QUALIFY r <= 3),
p AS (SELECT s.label, s.i, base, neighbour, u FROM s JOIN ranked USING (label, rk) JOIN near USING (label, base, r))
SELECT p.label, i, base, neighbour, round(sum(a.x + u * (b.x - a.x)), 4) AS total FROM p JOIN l a ON a.vec_id = base JOIN l b ON b.vec_id = neighbour AND a.k = b.k GROUP BY ALL""")
def smote(spark, d):
    return rebalance.smote(features(spark, d), "vec_id", "v", "label").select("label", "i", "base", "neighbour", F.round(A.total(F.col("synthetic")), 4).alias("total"))


@query("class_weights", f"WITH {LABELLED}, c AS (SELECT lang, count(*) AS n FROM labelled GROUP BY 1) SELECT lang, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, d):
    return rebalance.class_weights(labelled(spark, d), "lang").withColumn("weight", F.round("weight", 6))


@query("ldam_margins", f"WITH {LABELLED}, c AS (SELECT lang, power(count(*), -0.25::DOUBLE) AS m FROM labelled GROUP BY 1) SELECT lang, round(m * 0.5 / max(m) OVER (), 6) AS margin FROM c")
def ldam_margins(spark, d):
    return rebalance.ldam_margins(labelled(spark, d), "lang").withColumn("margin", F.round("margin", 6))


@query("effective_number_weights", f"WITH {LABELLED}, c AS (SELECT lang, (1 - 0.9999::DOUBLE) / (1 - power(0.9999::DOUBLE, count(*))) AS w FROM labelled GROUP BY 1), n AS (SELECT lang, w * count(*) OVER () / sum(w) OVER () AS w FROM c) SELECT epoch::INT AS epoch, lang, round(CASE WHEN epoch < 60 THEN 1 ELSE w END, 6) AS weight FROM n, (SELECT unnest([0, 59, 60, 80]) AS epoch)")
def effective_number_weights(spark, d):
    epochs = spark.createDataFrame([(e,) for e in (0, 59, 60, 80)], "epoch int")
    return rebalance.effective_number_weights(labelled(spark, d), "lang", epochs=epochs).withColumn("weight", F.round("weight", 6))
