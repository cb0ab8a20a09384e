"""Queries of profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import profile
from cairnwork.plans.base import CENTRED, LABELLED, LONG, centred, features, labelled, long_features, query, table


def rounded(df, columns, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


@query("class_distribution", "SELECT label, n, round(100 * n / sum(n) OVER (), 4) AS percent, round(max(n) OVER () / n, 4) AS imbalance FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def class_distribution(spark, d):
    return rounded(profile.class_distribution(table(spark, d, "embeddings"), "label"), ("percent", "imbalance"))


@query("describe_by_group", "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS max FROM events GROUP BY 1")
def describe_by_group(spark, d):
    return rounded(profile.describe_by_group(table(spark, d, "events"), ["event_type"], "value"), ("mean", "std", "q25", "q50", "q75"))


@query("feature_summary_topk", f"WITH {LONG}, s AS (SELECT k, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max FROM long GROUP BY k) SELECT k, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(std / greatest(abs(mean), 1e-10), 3) AS cv FROM s ORDER BY s.std DESC, k LIMIT 10")
def feature_summary_topk(spark, d):
    return rounded(rounded(profile.feature_summary_topk(long_features(spark, d)), ("mean", "std", "min", "max"), 6), ("cv",), 3)


@query("energy_stats", "SELECT min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events")
def energy_stats(spark, d):
    return rounded(profile.energy_stats(table(spark, d, "events"), "value"), ("mean", "std"))


@query("five_number_summary", f"WITH {LONG}, b AS (SELECT label, k, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM long GROUP BY ALL) SELECT label, k, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(min(x), 6) AS low, round(max(x), 6) AS high FROM long JOIN b USING (label, k) WHERE x >= q25 - 1.5 * (q75 - q25) AND x <= q75 + 1.5 * (q75 - q25) GROUP BY ALL")
def five_number_summary(spark, d):
    return rounded(profile.five_number_summary(long_features(spark, d), ["label", "k"], "x"), ("q25", "q50", "q75", "low", "high"), 6)


@query("histogram_bins", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total, (max(value) - min(value)) / 30 AS w FROM events), b AS (SELECT least(floor((value - lo) / w), 29)::INT AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1) SELECT i::INT AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * w), 8) AS density FROM range(30) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = i")
def histogram_bins(spark, d):
    return rounded(rounded(profile.histogram_bins(table(spark, d, "events"), "value", 30), ("low", "high"), 6), ("density",), 8)


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "documents"), "lang")


@query("distinct_per_class", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS values, count(*) AS n FROM documents GROUP BY source")
def distinct_per_class(spark, d):
    return profile.distinct_per_class(table(spark, d, "documents"), "source", "lang")


@query("group_size_stats", "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS groups, min(n) AS min, max(n) AS max, quantile_cont(n, 0.5)::DOUBLE AS median FROM s")
def group_size_stats(spark, d):
    return profile.group_size_stats(table(spark, d, "orders"), "o_custkey")


CORR = f"WITH {LONG}, r AS (SELECT a.k AS i, b.k AS j, corr(a.x, b.x) AS r FROM long a JOIN long b USING (vec_id) GROUP BY ALL)"


@query("correlation_matrix", f"{CORR} SELECT i, j, round(r, 6) AS r FROM r")
def correlation_matrix(spark, d):
    return rounded(profile.correlation_matrix(features(spark, d)), ("r",), 6)


@query("correlated_pairs", f"{CORR}, u AS (SELECT i, j, r, abs(r) AS size FROM r WHERE i < j), t AS (SELECT i, j, r FROM u ORDER BY size DESC, i, j LIMIT 10), s AS (SELECT avg(size) AS mean_abs, max(size) AS max_abs, count(*) FILTER (size > 0.8) AS above_80, count(*) FILTER (size > 0.9) AS above_90 FROM u) SELECT i, j, round(r, 6) AS r, round(mean_abs, 6) AS mean_abs, round(max_abs, 6) AS max_abs, above_80, above_90 FROM t, s")
def correlated_pairs(spark, d):
    summary, top = profile.correlated_pairs(features(spark, d))
    return rounded(top.crossJoin(summary), ("r", "mean_abs", "max_abs"), 6)  # ten rows and one


@query("interclass_variance_topk", f"WITH {LONG}, m AS (SELECT label, k, avg(x) AS m FROM long GROUP BY ALL), v AS (SELECT k, var_samp(m) AS variance FROM m GROUP BY k) SELECT k, round(variance, 8) AS variance FROM v ORDER BY v.variance DESC, k LIMIT 10")
def interclass_variance_topk(spark, d):
    return rounded(profile.interclass_variance_topk(long_features(spark, d)), ("variance",), 8)


@query("reindex_fill", f"WITH {LABELLED}, m AS (SELECT lang, avg(quality) AS quality FROM labelled WHERE lang <> 'es' GROUP BY lang) SELECT lang, round(coalesce(quality, 0), 6) AS quality FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN m USING (lang)")
def reindex_fill(spark, d):
    means = labelled(spark, d).where("lang <> 'es'").groupBy("lang").agg(F.avg("quality").alias("quality"))
    return rounded(profile.reindex_fill(means, table(spark, d, "documents").select("lang").distinct(), "lang", "quality"), ("quality",), 6)


@query("augment_effect", f"""WITH {CENTRED}, v AS (SELECT series_id, 'original' AS variant, x FROM centred UNION ALL SELECT series_id, 'gain', x * power(10, 6 / 20.0::DOUBLE) FROM centred UNION ALL SELECT series_id, 'flip', -x FROM centred),
s AS (SELECT variant, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM v GROUP BY variant), l AS (SELECT variant, 'rms' AS feature, rms AS y FROM s UNION ALL SELECT variant, 'peak', peak FROM s)
SELECT feature, round(max(y) FILTER (variant = 'original'), 4) AS original, round(max(y) FILTER (variant = 'gain'), 4) AS gain, round(max(y) FILTER (variant = 'flip'), 4) AS flip FROM l GROUP BY feature""")
def augment_effect(spark, d):
    x = F.col("x")
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("y")) for n, e in (("original", x), ("gain", x * 10 ** (6 / 20)), ("flip", -x))])).alias("v")
    s = centred(spark, d).select(variants).select("v.*").groupBy("variant").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms"), F.max(F.abs("y")).alias("peak"))
    long = s.select("variant", F.explode(F.array(F.struct(F.lit("rms").alias("feature"), F.col("rms").alias("y")), F.struct(F.lit("peak").alias("feature"), F.col("peak").alias("y")))).alias("l")).select("variant", "l.*")
    return rounded(long.groupBy("feature").pivot("variant", ["original", "gain", "flip"]).agg(F.max("y")), ("original", "gain", "flip"))
