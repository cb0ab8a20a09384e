"""Queries of splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.operators import splits
from cairnwork.plans.base import LABELLED, LONG, SAMPLES, features, labelled, query, quota_sql, samples, table

U32 = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0)"


@query("stratified_holdout", f"WITH {LABELLED},\n{quota_sql('labelled', 'quality', 'doc_id', '0.2', 42, 'held')}\nSELECT doc_id, quality, split FROM held")
def stratified_holdout(spark, d):
    return splits.stratified_holdout(labelled(spark, d), "quality", "doc_id").select("doc_id", "quality", "split")


@query(
    "stratified_three_way",
    f"""WITH {LABELLED},
{quota_sql('labelled', 'quality', 'doc_id', '0.15', 42, 'one')},
rest AS (SELECT * EXCLUDE (split) FROM one WHERE split = 'train'),
{quota_sql('rest', 'quality', 'doc_id', '(0.15 / 0.85)', 43, 'two')}
SELECT doc_id, quality, split FROM one WHERE split = 'test'
UNION ALL SELECT doc_id, quality, CASE split WHEN 'test' THEN 'val' ELSE 'train' END FROM two""",
)
def stratified_three_way(spark, d):
    return splits.stratified_three_way(labelled(spark, d), "quality", "doc_id").select("doc_id", "quality", "split")


GROUPED = """g AS (SELECT source, row_number() OVER (ORDER BY md5('42|' || source)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
s AS (SELECT *, ceil(round(n * 0.15, 9)) AS n_test FROM g),
z AS (SELECT *, ceil(round((n - n_test) * (0.15 / 0.85), 9)) AS n_val FROM s),
grouped AS (SELECT doc_id, source, lang, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM documents JOIN z USING (source))"""


def grouped(spark, d):
    return splits.grouped_holdout(table(spark, d, "documents").select("doc_id", "source", "lang"), "source")


@query("grouped_holdout", f"WITH {GROUPED} SELECT doc_id, source, split FROM grouped")
def grouped_holdout(spark, d):
    return grouped(spark, d).select("doc_id", "source", "split")


@query("split_distribution", f"WITH {GROUPED} SELECT split, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in ("en", "fr", "de", "es")) + " FROM grouped GROUP BY split")
def split_distribution(spark, d):
    return splits.split_distribution(grouped(spark, d), "split", "lang", ["en", "fr", "de", "es"])


@query("assert_no_leakage", f"WITH {GROUPED}, p AS (SELECT DISTINCT source, split FROM grouped), n AS (SELECT DISTINCT split FROM p), e AS (SELECT a.split AS a, b.split AS b FROM n a JOIN n b ON a.split < b.split) SELECT a, b, (SELECT count(*) FROM p x JOIN p y USING (source) WHERE x.split = e.a AND y.split = e.b) AS shared FROM e")
def assert_no_leakage(spark, d):
    return splits.assert_no_leakage(grouped(spark, d), "source", "split")


@query("stratified_kfold", "SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) - 1) % 5)::INT AS fold FROM embeddings")
def stratified_kfold(spark, d):
    return splits.stratified_kfold(features(spark, d).select("vec_id", "label"), "label", "vec_id")


@query("head_n_per_class", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS place FROM embeddings QUALIFY place <= 10")
def head_n_per_class(spark, d):
    return splits.head_n_per_class(features(spark, d).select("vec_id", "label"), "label", "vec_id", 10)


@query("cap_sample", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber) LIMIT 5000")
def cap_sample(spark, d):
    return splits.cap_sample(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("stride_downsample", f"WITH {SAMPLES}, l AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY series_id) // 16) AS s FROM samples) SELECT series_id, t, x FROM l WHERE t % s = 0 AND t // s < 16")
def stride_downsample(spark, d):
    return splits.stride_downsample(samples(spark, d), 16)


@query(
    "balanced_sampler",
    f"""WITH {LABELLED},
c AS (SELECT quality, count(*) AS n FROM labelled GROUP BY quality),
b AS (SELECT quality, n, (row_number() OVER (ORDER BY quality) - 1) * (1.0::DOUBLE / count(*) OVER ()) AS low, row_number() OVER (ORDER BY quality) * (1.0::DOUBLE / count(*) OVER ()) AS high FROM c),
u AS (SELECT range AS draw, {U32.format("'42|' || range")} AS u, {U32.format("'43|' || range")} AS v FROM range(2000)),
p AS (SELECT draw, quality, floor(v * n)::BIGINT + 1 AS place FROM u JOIN b ON u.u >= b.low AND u.u < b.high),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id)) AS place FROM labelled)
SELECT draw, quality, doc_id FROM p JOIN r USING (quality, place)""",
)
def balanced_sampler(spark, d):
    return splits.balanced_sampler(labelled(spark, d), "quality", "doc_id", 2000)


@query("mask_by_class", f"WITH {LONG} SELECT vec_id, label, label = 3 AS in_class FROM embeddings")
def mask_by_class(spark, d):
    return features(spark, d).select("vec_id", "label", (F.col("label") == 3).alias("in_class"))
