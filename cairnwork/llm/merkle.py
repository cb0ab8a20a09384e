r"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words, in DataFrame functions alone.

A text's sections stand between double line ends, a section's paragraphs between line ends. A paragraph is cut to runs at
borders that its content defines: behind each word whose MD5 starts with 0 to 3, so that a run has four words on
average at any length of text, and an inserted or deleted word changes the run it stands in and leaves the others. The tree's leaves are the
runs' hashes; a paragraph's node is the hash of its leaves, a section's that of its paragraphs' nodes, the root that of the
sections' nodes. Runs hold every character of a paragraph, so that equal roots mean equal texts.

The fingerprint is a string: the root, "/", the sections joined by "|", each of them its paragraphs joined by ";", each of
those 16 digits of its node, ":" and 8 digits of each leaf.

likeness descends two trees from the root: equal roots give 1. Sections that both have are alike as a whole, the others are opened;
of their paragraphs those that both have are alike, the others are opened to their leaves. The result is twice the number of
leaves alike, divided by all leaves (each distinct section, paragraph and opened leaf counts once); 1 where neither text has leaves.
differing_paragraphs names the paragraphs whose nodes the other text lacks.

The next document in descending order: a window sees ids and hashes of texts alone, over buckets of neighbouring ids (quantiles of doc_id; rows with a null
id by their hash); the first row of each bucket follows the last of the bucket above. The texts are joined by id and hash.

Defined cases: null text counts as empty (no leaves); rows with a null id stand after all others, rows of equal id in order of
their text's hash; a table of one row has itself as next; an empty table gives no rows; other columns are not read. A very long text is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.llm.common import load, store, text_or_empty

#: Ids of one window (ids and hashes alone, which spill).
ROWS_PER_BUCKET = 200_000
#: Bounds that a row is compared with at once.
STRIDE = 64
#: A word whose MD5 is below this ends a run.
BORDER = "4"
MARK = "\x01"


def _marked(paragraph: F.Column) -> F.Column:
    """A space and the paragraph, MARK behind each word that ends a run."""
    words = F.split(F.concat(F.lit(" "), F.replace(paragraph, F.lit(MARK), F.lit(MARK + MARK))), " ")
    return F.array_join(F.transform(words, lambda w: F.when(F.md5(w) < BORDER, F.concat(w, F.lit(MARK))).otherwise(w)), " ")


def _leaves(marked: F.Column) -> F.Column:
    """MD5 of each run of a marked paragraph, in order; a border at the end leaves no empty run."""
    runs = F.split(F.when(marked.endswith(MARK), F.left(marked, F.length(marked) - 1)).otherwise(marked), MARK)
    return F.when(marked == " ", F.array().cast("array<string>")).otherwise(F.transform(runs, lambda r: F.md5(r)))


def sections(text: F.Column) -> F.Column:
    """Of each section struct(node, shown), shown as in the fingerprint."""
    each = lambda found, f: F.transform(found, lambda s: F.transform(s, f))
    tree = each(each(F.transform(F.split(text, "\n\n"), lambda s: F.split(s, "\n")), _marked), _leaves)
    nodes = each(tree, lambda x: F.struct(F.sha2(F.array_join(x, ","), 256).alias("node"), F.array_join(F.transform(x, lambda d: F.left(d, F.lit(8))), "").alias("leaves")))
    return F.transform(nodes, lambda s: F.struct(F.sha2(F.array_join(F.transform(s, lambda p: p["node"]), ","), 256).alias("node"), F.array_join(F.transform(s, lambda p: F.concat(F.left(p["node"], F.lit(16)), F.lit(":"), p["leaves"])), ";").alias("shown")))


def fingerprint(found: F.Column) -> F.Column:
    """The fingerprint of a text's sections()."""
    root = F.sha2(F.array_join(F.transform(found, lambda s: s["node"]), ";"), 256)
    return F.concat(root, F.lit("/"), F.array_join(F.transform(found, lambda s: s["shown"]), "|"))


def with_fingerprints(docs: DataFrame, **columns: str) -> DataFrame:
    """docs with a fingerprint for each name=text column."""
    trees = docs.withColumns({f"tree of {name}": sections(F.col(text)) for name, text in columns.items()})
    return trees.withColumns({name: fingerprint(F.col(f"tree of {name}")) for name in columns}).drop(*(f"tree of {name}" for name in columns))


def _paragraphs(of_sections: F.Column) -> F.Column:
    return F.array_distinct(F.flatten(F.transform(of_sections, lambda s: F.split(s, ";"))))


def _opened(paragraphs: F.Column) -> F.Column:
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring(p, 18, 1 << 30), F.lit(".{8}"), F.lit(0)))))


def _count(paragraphs: F.Column) -> F.Column:
    """Leaves of paragraphs as a fingerprint shows them."""
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + ((F.length(p) - 17) / 8).cast("int"))


def likeness(docs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """docs with the likeness of the fingerprints in columns a and b as column name."""
    part = lambda c, k: F.split(F.col(c), "/")[k]
    x, y, p, q, u, v = (f"{name} {k}" for k in "xypquv")
    d = docs.withColumns({x: F.split(part(a, 1), r"\|"), y: F.split(part(b, 1), r"\|")})
    d = d.withColumns({f"{name} s": F.array_intersect(x, y), p: _paragraphs(F.array_except(x, y)), q: _paragraphs(F.array_except(y, x))})
    d = d.withColumns({f"{name} c": F.array_intersect(p, q), u: _opened(F.array_except(p, q)), v: _opened(F.array_except(q, p))})
    alike = _count(F.flatten(F.transform(F.col(f"{name} s"), lambda s: F.split(s, ";")))) + _count(F.col(f"{name} c"))
    d = d.withColumn(f"{name} m", 2 * alike)
    every = F.col(f"{name} m") + F.size(u) + F.size(v)
    value = F.when((part(a, 0) == part(b, 0)) | (every == 0), 1.0).otherwise((F.col(f"{name} m") + 2 * F.size(F.array_intersect(u, v))) / every)
    return d.withColumn(name, value).drop(x, y, p, q, u, v, *(f"{name} {k}" for k in "scm"))


def differing_paragraphs(a: F.Column, b: F.Column) -> F.Column:
    """Numbers (from 0) of the first text's paragraphs whose nodes the second lacks; empty where the roots are equal."""
    own, other = (F.flatten(F.transform(F.split(F.split(x, "/")[1], r"\|"), lambda s: F.split(s, ";"))) for x in (a, b))
    lacking = F.map_from_arrays(*[F.array_except(own, other)] * 2)
    differing = F.filter(F.transform(own, lambda p, i: F.when(F.map_contains_key(lacking, p), i)), lambda i: i.isNotNull())
    return F.when(F.split(a, "/")[0] == F.split(b, "/")[0], F.array().cast("array<int>")).otherwise(differing)


def _bucket(keys: DataFrame) -> F.Column:
    """The bucket of neighbouring ids, descending; its bounds are quantiles of the ids. Null ids have 256 by their hash."""
    n = max(1, round(keys.count() / ROWS_PER_BUCKET))
    bounds = sorted(set(keys.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    value = F.col("id").cast("double")
    null = len(bounds) + 1 + F.conv(F.left("tie", F.lit(2)), 16, 10).cast("int")
    if not bounds:
        return F.when(value.isNull(), null).otherwise(0)
    every = F.array(*map(F.lit, bounds))
    far = F.size(F.filter(F.array(*map(F.lit, bounds[STRIDE - 1 :: STRIDE])), lambda b: b <= value)) * STRIDE if len(bounds) >= STRIDE else F.lit(0)
    near = F.size(F.filter(F.slice(every, far + 1, F.lit(STRIDE)), lambda b: b <= value))
    return F.when(value.isNull(), null).otherwise(len(bounds) - far - near)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending order of ids; after the last, the first."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("string").alias("text")).withColumn("tie", F.md5("text"))
    keys, _ = store(rows.select("id", "tie"), "ids")
    keys = keys.withColumn("bucket", _bucket(keys))
    order = W.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), "tie")
    following = lambda x, w: F.lead(F.struct("id", "tie", F.lit(1).alias("is"))).over(w)
    ranked = keys.select("*", following("", order).alias("later"), F.row_number().over(order).alias("place"))
    heads = ranked.where("place = 1").select("bucket", F.struct("id", "tie", F.lit(1).alias("is")).alias("head"))
    by_bucket = W.orderBy("bucket")  # one row a bucket: an id and a hash
    whole = by_bucket.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = heads.select("bucket", F.coalesce(F.lead("head").over(by_bucket), F.first("head").over(whole)).alias("head"))
    ranked = ranked.join(after, "bucket").withColumn("next", F.coalesce("later", "head"))
    pairs, _ = store(ranked.select("id", "tie", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie")), "neighbours")
    # texts by id and hash, each once
    texts = rows if pairs.groupBy("id", "tie").count().where("count > 1").isEmpty() else rows.dropDuplicates(["id", "tie"])
    texts = texts.select(F.coalesce("id", F.lit(0)).alias("i"), F.when(F.col("id").isNull(), F.concat(F.lit("-"), "tie")).otherwise(F.col("tie")).alias("t"), "text")
    key = lambda i, t: (F.coalesce(i, F.lit(0)), F.when(F.col(i).isNull(), F.concat(F.lit("-"), t)).otherwise(F.col(t)))
    pairs = pairs.select("id", *(c.alias(x) for c, x in zip([*key("id", "tie"), *key("next_id", "next_tie")], ("i", "t", "ni", "nt"), strict=True)))
    own = pairs.join(texts.hint("merge"), ["i", "t"]).select("id", F.col("text").alias("own"), "ni", "nt")
    # the same columns under the same names, so that both joins read one shuffle of the texts
    return own.join(texts.hint("merge"), (F.col("ni") == F.col("i")) & (F.col("nt") == F.col("t"))).select(F.col("id").alias("doc_id"), F.col("own").alias("text"), F.col("text").alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint, a row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("string").alias("text"))
    return with_fingerprints(rows, fingerprint="text").drop("text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document its fingerprint, that of its text edited with the next one's, and the likeness of both and of the next document's."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprints(rows, fingerprint="text", edited_fingerprint="edited", next_fingerprint="next_text")
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
    rows = likeness(likeness(rows, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return rows.drop("next_fingerprint")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(load(spark, sf_dir, "documents"))


def _tree_sql(text: str) -> str:
    marked = f"list_transform(string_split(' ' || replace(p, chr(1), chr(1) || chr(1)), ' '), lambda w: CASE WHEN md5(w) < '{BORDER}' THEN w || chr(1) ELSE w END)"
    runs = f"string_split(CASE WHEN ends_with(array_to_string({marked}, ' '), chr(1)) THEN array_to_string({marked}, ' ')[:-2] ELSE array_to_string({marked}, ' ') END, chr(1))"
    leaves_of = f"CASE WHEN p = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform({runs}, lambda r: md5(r)) END"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(list_transform(string_split(s, chr(10)), lambda p: {leaves_of}), lambda x: {{'node': sha256(coalesce(array_to_string(x, ','), '')), 'leaves': coalesce(array_to_string(list_transform(x, lambda d: d[:8]), ''), '')}}))"


def _shown_sql(tree: str) -> str:
    return f"list_transform({tree}, lambda s: array_to_string(list_transform(s, lambda p: p.node[:16] || ':' || p.leaves), ';'))"


def _root_sql(tree: str) -> str:
    return f"sha256(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string(list_transform(s, lambda p: p.node), ','))), ';'))"


def _without_sql(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))"


def _common_sql(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda x: list_contains({b}, x))"


def _paragraphs_sql(of_sections: str) -> str:
    return f"list_distinct(flatten(list_transform({of_sections}, lambda s: string_split(s, ';'))))"


def _opened_sql(paragraphs: str) -> str:
    return f"list_distinct(flatten(list_transform({paragraphs}, lambda p: regexp_extract_all(p[18:], '.{{8}}'))))"


def _count_sql(paragraphs: str) -> str:
    return f"coalesce(list_sum(list_transform({paragraphs}, lambda p: (length(p) - 17) // 8)), 0)"


def _likeness_sql(k: str, other: str, name: str) -> str:
    return f"""
{k}1 AS (SELECT doc_id, root, {other}root AS o, {_common_sql('shown', other + 'shown')} AS s, {_paragraphs_sql(_without_sql('shown', other + 'shown'))} AS p, {_paragraphs_sql(_without_sql(other + 'shown', 'shown'))} AS q FROM t),
{k}2 AS (SELECT doc_id, root, o, 2 * ({_count_sql("flatten(list_transform(s, lambda x: string_split(x, ';')))")} + {_count_sql(_common_sql('p', 'q'))}) AS m, {_opened_sql(_without_sql('p', 'q'))} AS u, {_opened_sql(_without_sql('q', 'p'))} AS v FROM {k}1),
{k} AS (SELECT doc_id, CASE WHEN root = o OR m + len(u) + len(v) = 0 THEN 1.0::DOUBLE ELSE (m + 2 * len({_common_sql('u', 'v')}))::DOUBLE / (m + len(u) + len(v)) END AS {name} FROM {k}2)"""


#: Ids are unique and not null here.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text, length(text) AS n_chars FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM n),
r AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_tree_sql('text')} AS tree, {_tree_sql('edited')} AS edited_tree, {_tree_sql('next_text')} AS next_tree FROM e),
t AS (SELECT doc_id, n_chars, edited_sha256, {', '.join(f"{_root_sql(x + 'tree')} AS {x}root, {_shown_sql(x + 'tree')} AS {x}shown" for x in ('', 'edited_', 'next_'))} FROM r),
{_likeness_sql('a', 'edited_', 'near_edited')},
{_likeness_sql('b', 'next_', 'near_next')}
SELECT t.doc_id, n_chars, edited_sha256, root || '/' || array_to_string(shown, '|') AS fingerprint, edited_root || '/' || array_to_string(edited_shown, '|') AS edited_fingerprint, near_edited, near_next
FROM t JOIN a USING (doc_id) JOIN b USING (doc_id)
"""
