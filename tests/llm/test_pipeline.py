"""The pipeline's stages, each on its own input, and the registered queries."""

import collections

import corpus_pipeline
from cairnwork.llm import queries
from tests.conftest import DATA
from tests.llm.test_operators import brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_have_their_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    clean = stages["quality_classifier"](spark, docs, DATA)
    assert clean.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1) and sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    exact = stages["exact_dedup"](spark, docs, DATA)
    assert exact.columns == docs.columns
    norm = lambda t: (t or "") if not t else " ".join(t.replace("\n", " ").split(" "))
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(first.values())
    near = stages["ngram_jaccard_join"](spark, docs, DATA)
    assert near.columns == docs.columns
    want = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert {r.doc_id for r in near.collect()} == {i for i, _, c in want if i == c}
    masked = stages["secret_scan"](spark, docs, DATA).collect()
    assert len(masked) == len(before) and not any("AKIA" in (r.text or "") for r in masked) and all(r.n_chars == len(r.text) for r in masked)


def test_stages_take_odd_rows(spark):
    rows = [(1, "same text here", "en", "s", 14), (1, "same text here", "en", "s", 14), (None, "same text here", None, None, None), (None, None, None, None, None), (None, "other", "en", "s", 5), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact_dedup"](spark, docs, DATA)
    assert collections.Counter((r.doc_id, r.text) for r in exact.collect()) == collections.Counter([(1, "same text here"), (None, "other"), (2, "")])
    near = " ".join(f"w{k}" for k in range(80))
    more = spark.createDataFrame([(7, near, "en", "s", 5), (7, near + " x", "en", "s", 5), (None, near + " y", "en", "s", 5), (None, near + " z", "en", "s", 5), (8, "p q", "en", "s", 5), (None, "p q", "en", "s", 5)], COLUMNS)
    found = stages["ngram_jaccard_join"](spark, docs.union(more), DATA).collect()
    assert collections.Counter(r.text for r in found if r.text not in (near, near + " x")) == collections.Counter(["same text here", "other", None, "", "p q"])
    assert len([r for r in found if r.doc_id == 7]) == 1 and {r.doc_id for r in found if r.text == "p q"} == {8}
    assert stages["secret_scan"](spark, docs, DATA).count() == len(rows)
    assert stages["best_fit_packing"](spark, docs, DATA).count() == len(rows)
    assert stages["quality_classifier"](spark, docs, DATA).columns == docs.columns
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    for name in ("op1_exact_dedup", "op4_fingerprints", "op5_license_scan", "op7_html_extract", "op8_secret_scan"):
        table = "pages" if name.startswith("op7") else "documents"
        assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
