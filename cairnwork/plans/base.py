"""Tables that many queries start from, each with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, lang, n_chars, quality, toxic of labelled documents; the text stays unread."""
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")


LABELLED = "labelled AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """series_id, t, x: the values of each user's events in order."""
    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("series_id"), t.alias("t"), F.col("value").alias("x"))


SAMPLES = "samples AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events)"


#: Near the middle of the values; what is left of them has both signs.
CENTRE = 250.0


def centred(spark: SparkSession, d: str) -> DataFrame:
    """samples less CENTRE, where a sign is needed."""
    return samples(spark, d).withColumn("x", F.col("x") - CENTRE)


CENTRED = SAMPLES + f", centred AS (SELECT series_id, t, x - {CENTRE}::DOUBLE AS x FROM samples)"


def features(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, v: embeddings as double arrays."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def long_features(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, k, x."""
    return features(spark, d).select("vec_id", "label", F.posexplode("v").alias("k", "x"))


LONG = "long AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def quota_sql(source: str, label: str, key: str, share: str, seed: int, out: str) -> str:
    """CTEs {out}_q and {out}: source with its stratified split."""
    return f"""{out}_n AS (SELECT {label}, count(*) AS n, sum(count(*)) OVER () AS total, ceil(round(sum(count(*)) OVER () * {share}, 9)) AS want FROM {source} GROUP BY {label}),
{out}_d AS (SELECT *, n * want / total AS due, floor(n * want / total) AS fl FROM {out}_n),
{out}_q AS (SELECT {label}, fl + CASE WHEN row_number() OVER (ORDER BY round(due - fl, 9) DESC, {label}) <= want - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM {out}_d),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}|' || {key})) AS rank_in_class FROM {source}),
{out} AS (SELECT r.* EXCLUDE (rank_in_class), CASE WHEN rank_in_class <= quota THEN 'test' ELSE 'train' END AS split FROM {out}_r r JOIN {out}_q USING ({label}))"""


def holdout(spark: SparkSession, d: str) -> DataFrame:
    """features with split."""
    return splits.stratified_holdout(features(spark, d), "label", "vec_id", 0.2, 42)


HOLDOUT = LONG + ",\nids AS (SELECT vec_id, label FROM embeddings),\n" + quota_sql("ids", "label", "vec_id", "0.2", 42, "held")
