"""The registered queries themselves, over whole small tables."""

import zlib

import duckdb
import numpy as np

from cairnwork.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_query(spark):
    tokenizer = library("word_bpe_49k.json")
    rows = QUERIES["op2_best_fit_packing"](spark, DATA).collect()
    want = {}
    for i, text in texts(spark).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= sum(n for _, n, _ in want.values()) / 4096 * 1.05 + 1


def test_token_store_query(spark):
    tokenizer = library("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in QUERIES["op10_token_store"](spark, DATA).collect()}
    at, docs = 0, texts(spark)
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i], add_special_tokens=False).ids, 0]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(docs)


def test_jaccard_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLES['op6_ngram_jaccard']})").fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_jaccard"](spark, DATA).collect()) == want


def test_quality_query(spark):
    rows = QUERIES["op9_quality"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts(spark))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    told = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in told) >= 0.9 * len(told)


def test_sentencepiece_query(spark):
    """A row a document; the ids' own test is elsewhere."""
    rows = QUERIES["op3_sentencepiece"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts(spark))
