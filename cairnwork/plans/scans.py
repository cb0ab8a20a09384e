"""Queries of sources, sinks and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.operators import metrics, quality
from cairnwork.plans import evaluation
from cairnwork.plans.base import SAMPLES, features, holdout, query, samples, table
from cairnwork.plans.splitting import GROUPED, grouped
from cairnwork.sources import files, stores
from cairnwork.sources.stores import scratch

EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


#: Folders and name endings that paths are made of.
FOLDERS, ENDINGS = ["hunger", "tiredness", "other"], ["wav", "MP3", "txt", "ogg", "Flac", "m4a", "wav.part"]
PATH = f"'/clips/' || ({FOLDERS})[page_id % 3 + 1] || '/' || replace(regexp_replace(url, '^https?://', ''), '/', '-') || '.' || ({ENDINGS})[page_id % 7 + 1]"


@query("scan_labelled_files", rf"""WITH p AS (SELECT {PATH} AS path, length(html)::BIGINT AS length FROM pages)
SELECT split_part(path, '/', -2) AS label, regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') AS stem, lower(regexp_extract(path, '\.([^.]*)$', 1)) AS extension, length FROM p
WHERE regexp_matches(lower(path), '\.(flac|m4a|mp3|ogg|wav)$') AND split_part(path, '/', -2) IN ('hunger', 'tiredness') ORDER BY label, stem""")
def scan_labelled_files(spark, d):
    """Paths of clips made from the pages' addresses: of two classes, with the extensions of clips in either case, by name."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod("page_id", F.lit(n)).cast("int"))
    plain = F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("-"))
    path = F.concat(F.lit("/clips/"), pick(FOLDERS, 3), F.lit("/"), plain, F.lit("."), pick(ENDINGS, 7))
    paths = table(spark, d, "pages").select(path.alias("path"), F.length("html").cast("long").alias("length"))
    return files.labelled_paths(paths, FOLDERS[:2]).select("label", "stem", "extension", "length").orderBy("label", "stem")


STEM = "replace(replace(regexp_replace(url, '^https?://', ''), '/', '-'), '.', CASE WHEN page_id % 3 = 0 THEN '_aug_' ELSE '.' END)"


def stems(spark, d):
    plain = F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("-"))
    return table(spark, d, "pages").select("page_id", F.replace(plain, F.lit("."), F.when(F.col("page_id") % 3 == 0, "_aug_").otherwise(".")).alias("stem"))


@query("filter_originals", f"SELECT page_id, {STEM} AS stem FROM pages WHERE NOT contains({STEM}, '_aug_')")
def filter_originals(spark, d):
    return files.filter_originals(stems(spark, d))


@query("derive_group_key", f"SELECT page_id, lower(substr(split_part({STEM}, '_aug_', 1), 1, 36)) AS group_id FROM pages")
def derive_group_key(spark, d):
    return stems(spark, d).select("page_id", files.group_key(F.col("stem")).alias("group_id"))


@query("encode_label", f"SELECT event_id, event_type, (nullif(list_position({EVENT_TYPES}, event_type), 0) - 1)::INT AS label_idx FROM events")
def encode_label(spark, d):
    return files.encode_label(table(spark, d, "events").select("event_id", "event_type"), "event_type", EVENT_TYPES)


@query("fix_length", f"WITH {SAMPLES}, g AS (SELECT DISTINCT series_id FROM samples) SELECT g.series_id, i::INT AS i, coalesce(s.x, 0) AS x FROM g CROSS JOIN range(64) r(i) LEFT JOIN samples s ON s.series_id = g.series_id AND s.t = i")
def fix_length(spark, d):
    x = samples(spark, d).where("t < 64").groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("x"))  # 64 values a series
    return x.select("series_id", F.posexplode(A.fix_length(F.col("x"), 64)).alias("i", "x"))


BAD = "n_chars < 40 OR length(trim(text)) = 0"


def documents(spark, d):
    return table(spark, d, "documents")


@query("quarantine_bad_rows", f"SELECT doc_id, coalesce({BAD}, true) AS rejected, CASE WHEN coalesce({BAD}, true) THEN 0 ELSE n_chars END AS n_chars FROM documents")
def quarantine_bad_rows(spark, d):
    bad = (F.col("n_chars") < 40) | (F.length(F.trim("text")) == 0)
    valid, rejected = quality.quarantine(documents(spark, d), bad)
    kept = valid.select("doc_id", F.lit(False).alias("rejected"), "n_chars")
    return kept.unionByName(quality.on_error(rejected.select("doc_id", F.lit(True).alias("rejected"), "n_chars"), F.lit(True), ["n_chars"], "zero"))


@query("write_split_manifest", f"WITH {GROUPED} SELECT split, doc_id, lang FROM grouped")
def write_split_manifest(spark, d):
    path = scratch(spark, "manifest")
    stores.write_split_manifest(grouped(spark, d).select("split", "doc_id", "lang"), path)
    return stores.read_split_manifest(spark, path, "split string, doc_id long, lang string")


@query("feature_store", f"WITH {evaluation.HOLDOUT} SELECT vec_id, h.label, split, round(sum(x), 4) AS total, count(*) AS n FROM long l JOIN held h USING (vec_id) GROUP BY ALL")
def feature_store(spark, d):
    path = scratch(spark, "features")
    stores.save_features(holdout(spark, d), path, "embeddings", [f"e{i}" for i in range(64)])
    back = stores.load_features(spark, path, "embeddings")
    return back.select("vec_id", "label", F.col("split").cast("string").alias("split"), F.round(A.total(F.col("v")), 4).alias("total"), F.size("v").cast("long").alias("n"))


@query("write_metrics", f"WITH {evaluation.METRICS} SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(mcc, 6) AS mcc FROM every")
def write_metrics(spark, d):
    path = scratch(spark, "metrics")
    found = metrics.evaluate(evaluation.by_model(spark, d), ["model"], evaluation.domain(spark, d))
    stores.write_metrics(found.select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "mcc")]), path)
    return spark.read.schema("accuracy double, macro_f1 double, mcc double, model string").json(f"{path}/models").select("model", "accuracy", "macro_f1", "mcc")


@query("purge_derived", f"SELECT page_id, {STEM} AS stem, (SELECT count(*) FROM pages WHERE contains({STEM}, '_aug_')) AS purged FROM pages WHERE NOT contains({STEM}, '_aug_')")
def purge_derived(spark, d):
    path = scratch(spark, "originals")
    gone = stores.purge_derived(stems(spark, d), "stem", path)
    return spark.read.parquet(path).withColumn("purged", F.lit(gone).cast("long"))


RATIO = "SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE round(l_tax / l_discount, 6) END AS r FROM lineitem"


def ratios(spark, d):
    """Tax over discount with the divisions by zero that floating point makes."""
    zero = F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_discount") == 0, zero).otherwise(F.round(F.try_divide("l_tax", "l_discount"), 6)).alias("r"))


@query("nonfinite_to_zero", f"WITH q AS ({RATIO}) SELECT l_orderkey, l_linenumber, CASE WHEN isnan(r) OR isinf(r) THEN 0 ELSE r END AS r FROM q")
def nonfinite_to_zero(spark, d):
    return ratios(spark, d).select("l_orderkey", "l_linenumber", A.finite_or_zero(F.col("r")).alias("r"))


@query("nonfinite_audit", f"WITH q AS ({RATIO}) SELECT l_returnflag, 'r' AS feature, count(*) FILTER (isnan(r)) AS n_nan, count(*) FILTER (isinf(r)) AS n_inf FROM q GROUP BY 1")
def nonfinite_audit(spark, d):
    return quality.nonfinite_audit(ratios(spark, d), ["r"], ["l_returnflag"])


@query("silence_filter", f"WITH {SAMPLES}, r AS (SELECT series_id, sqrt(avg(x * x)) AS rms FROM samples GROUP BY 1) SELECT series_id, round(rms, 4) AS rms, rms < 60 AS silent FROM r")
def silence_filter(spark, d):
    return quality.silence_filter(samples(spark, d), 60.0).withColumn("rms", F.round("rms", 4))


@query("length_audit", "WITH c AS (SELECT count(n_chars) AS n, count(*) FILTER (n_chars < 1000) AS padded, count(*) FILTER (n_chars > 1000) AS truncated, count(*) FILTER (n_chars = 1000) AS exact FROM documents) SELECT *, round(100 * padded / n, 4) AS padded_percent, round(100 * truncated / n, 4) AS truncated_percent, round(100 * exact / n, 4) AS exact_percent FROM c")
def length_audit(spark, d):
    return quality.length_audit(documents(spark, d), "n_chars", 1000)


@query("feature_slice", "SELECT vec_id, unnest(range(13))::INT AS k, round(unnest(embedding[1:13])::DOUBLE, 6) AS x FROM embeddings")
def feature_slice(spark, d):
    return features(spark, d).select("vec_id", F.posexplode(F.slice("v", 1, 13)).alias("k", "x")).withColumn("x", F.round("x", 6))
