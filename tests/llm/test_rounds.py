"""Byte pair encoding by merge rounds against the tokenizers library, whitening and clustering against brute force."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import mergerounds
from tests.conftest import DATA

WORDS = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def own():
    return mergerounds.Codec(WORDS)


ODD = [
    "'s", "'RE", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "Σ", "ΑΣ", "é", "é", "İ", "\x1c", "\x85", " ", "\n", " ", "1", "٣", "½", "一", "二三", "😀",
    "👩‍👩‍👧", "̴̣ͅ", "ʼ", "'", "''", "!!", "...", "hello", "THE", "Ᲊ", "՘", "\x00", "ǅ", "ﬁ", "ẞ", "가", "각", "가", "\U00010d50", "\U000323b0",
]


def test_ids_and_texts_equal_the_library(own, library):
    rnd = random.Random(5)
    texts = [None, "", "  ", "\x00", "<|endoftext|>", *ODD]
    texts += ["".join(rnd.choice(ODD) if rnd.random() < 0.6 else "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert own.decode(np.array([5, 10**7, 7])) == library.decode([5, 10**7, 7], skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 500_000, "一" * 50_000, "!?" * 40_000, "".join(random.Random(2).choice("etaoinshr") for _ in range(60_000))], ids=["one letter", "wide", "marks", "letters"])
def test_very_long_words(own, library, text):
    assert next(own.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_both_schedules_windows_and_a_forgetful_memo_agree(own, library, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("abcdenst") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for name, value in (("LONG", 3), ("WINDOW", 40), ("MEMO_WORDS", 50)):
        monkeypatch.setattr(mergerounds, name, value)
        fresh = mergerounds.Codec.__new__(mergerounds.Codec)
        fresh.__dict__.update(own.__dict__, memo={}, older={})
        assert [x.tolist() for x in fresh.encode(texts)] == want


def test_ranks_that_fall_while_merging(tmp_path):
    """'ab' is made after the pair 'ab c' already ranks before it: one place at a time, as the library does."""
    from tokenizers import Tokenizer

    letters = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    merges = [["ab", "a"], ["b", "a"], ["a", "b"], ["ab", "ab"], ["ba", "b</w>"], ["aba", "b"]]
    vocab = {s: i for i, s in enumerate([*letters, "aba", "ba", "ab", "abab", "bab</w>"])}
    from cairnwork.llm.tokens import BYTE_LETTERS

    for b in BYTE_LETTERS.values():
        for s in (b, b + "</w>"):
            vocab.setdefault(s, len(vocab))
    source = json.load(open(WORDS, encoding="utf-8"))
    source["added_tokens"] = []
    source["model"] |= {"vocab": vocab, "merges": merges}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(source), encoding="utf-8")
    own, library = mergerounds.Codec(str(path)), Tokenizer.from_file(str(path))
    assert not own.table.ordered
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice("aabbc ") for _ in range(rnd.randint(0, 40)))
        assert next(own.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids


def test_op11_query(spark, library):
    from cairnwork.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe_rounds"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_odd_rows(spark, own):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "Hello  World", None), (2, "Hello  World", None)], "doc_id long, text string, ids string")
    found = mergerounds.encode(df, WORDS)
    rows = sorted(((r.doc_id or 0, list(r.ids)) for r in found.collect()))
    hello = next(own.encode(["hello world"])).tolist()
    assert rows == [(0, []), (1, []), (2, hello), (2, hello)]
    back = sorted((r.doc_id or 0, r.text) for r in mergerounds.decode(found, WORDS).collect())
    assert back == [(0, ""), (1, ""), (2, "hello</w> world</w>"), (2, "hello</w> world</w>")]
    assert [r.text for r in mergerounds.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), WORDS).collect()] == [None]
    assert mergerounds.digests(df.limit(0), WORDS).count() == 0
    assert {r.n_tokens for r in mergerounds.digests(df.withColumn("n_tokens", F.lit("z")), WORDS).collect()} == {0, 2}


# ---------------------------------------------------------------- whitening


def whitened_by_hand(vectors, wanted=4):
    """n, deviation by x, components, values, trace, with exact integers and a dense eigendecomposition."""
    x = np.array(sorted(set(vectors)), np.int64)
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return n, s, turn[:, ::-1][:, :wanted], values[::-1][:wanted], np.trace(centred.T @ centred) / n


def check_whitened(rows, ids, x, tolerance=1e-8):
    n, s, components, values, trace = whitened_by_hand([tuple(v) for v in x])
    assert len(rows) == len(ids) * len(values)
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(len(values)):
        want = (np.array(x) - s / n) @ components[:, k] / np.sqrt(values[k])
        got = np.array([by[i, k + 1].pop().whitened for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < tolerance
    for r in rows:
        assert r.n == n and abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for i, v in zip(ids, x, strict=True)}
    assert all(r.deviation == deviation[r.vec_id] == int(r.deviation_exact) for r in rows)


def test_op12_query(spark):
    from cairnwork.llm.queries import QUERIES

    source = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = [r.vec_id for r in source]
    x = [[int(np.floor(256 * np.float64(c))) for c in r.embedding] for r in source]
    rows = QUERIES["op12_embedding_whitening"](spark, DATA).collect()
    check_whitened(rows, ids, x)


@pytest.mark.parametrize("spectrum", ["near", "equal", "low rank", "steep"])
def test_subspace_iteration(spectrum):
    """Near and equal eigenvalues around the wanted ones, rank below the block's width, eigenvalues over many magnitudes."""
    from cairnwork.llm import whitening

    rng = np.random.default_rng(4)
    d = 60
    values = {
        "near": 1 + 1e-4 * np.arange(d)[::-1], "equal": np.r_[5.0, 4.0, 3.0, 3.0, 3.0, np.ones(d - 5)], "low rank": np.r_[3.0, 2.0, 1.0, np.zeros(d - 3)], "steep": 10.0 ** -np.arange(d),
    }[spectrum]
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = basis * values @ basis.T
    q, found, passes = whitening.leading(lambda b: v @ b, d)
    assert np.allclose(found, values[:4], rtol=1e-10, atol=1e-12)
    assert np.abs(v @ q - q * found).max() < 1e-11 * values[0] and np.allclose(q.T @ q, np.eye(4), atol=1e-12)
    assert passes < 3000


def test_whitening_odd_rows(spark):
    from cairnwork.llm import whitening

    rng = np.random.default_rng(9)
    good = [[float(v) for v in rng.normal(0, 3, 5)] for _ in range(40)]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(100, good[0], "y"), (100, good[0], "y"), (None, good[1], None)]
    rows += [(200, None, "z"), (201, [None, 1.0, 2.0, 3.0, 4.0], "z"), (202, [float("nan")] * 5, "z"), (203, [float("inf")] * 5, "z"), (204, [], "z"), (205, [1.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    out = whitening.whiten(df).collect()
    assert {r.vec_id for r in out} == {*range(40), 100, None} and len(out) == 4 * 43
    ids = list(range(40))
    check_whitened([r for r in out if r.vec_id is not None and r.vec_id < 40], ids, [[int(np.floor(256 * c)) for c in v] for v in good])
    assert len({r.whitened for r in out if r.vec_id in (0, 100) and r.component == 1}) == 1
    assert whitening.whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 3.0]), (2, [2.0, 3.0]), (3, [5.0, 3.0])], "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 3 and all(abs(r.explained - 1) < 1e-12 for r in flat)
    far = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e12, 3.0]), (3, [5e11, 3.0])], "vec_id long, embedding array<double>")).collect()
    x = [[256 * 10**9, 0], [-256 * 10**12, 768], [128 * 10**12, 768]]
    s = [sum(c) for c in zip(*x, strict=True)]
    for r in far:
        exact = sum((3 * a - b) ** 2 for a, b in zip(x[r.vec_id - 1], s, strict=True))
        assert r.deviation is None and int(r.deviation_exact) == exact


# ---------------------------------------------------------------- clustering


def clustered_by_hand(ids, x, clusters=8, rounds=10, seed=3):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i]))
    centres = [list(x[i]) for i in order[:clusters]]

    def assign():
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((min(range(len(d)), key=lambda k: (d[k], k)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for k in range(len(centres)):
            mine = [v for v, (c, _) in zip(x, own, strict=True) if c == k]
            if mine:
                centres[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]


def test_op13_query_and_sql(spark):
    import duckdb

    from cairnwork.llm.queries import ORACLES, QUERIES

    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted(tuple(r[n] for n in names) for r in QUERIES["op13_centroid_clustering"](spark, DATA).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(ORACLES["op13_centroid_clustering"]).df()[names]
    assert got == sorted(map(tuple, want.itertuples(index=False)))
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in source], [[int(np.floor(1024 * np.float64(c))) for c in r.embedding] for r in source]
    own, shas = clustered_by_hand(ids, x)
    assert sorted((i, k, d, shas[k]) for i, (k, d) in zip(ids, own, strict=True)) == [(r[0], r[1], r[2], r[5]) for r in got]


def test_clustering_odd_rows(spark, monkeypatch):
    from cairnwork.llm import centroids, vectorblocks

    monkeypatch.setattr(vectorblocks, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    ids = [*range(30), 30, 30, 30, None, None]
    good = [[float(v) for v in rng.integers(-2, 3, 3)] for _ in ids]
    good[31] = good[30]
    rows = [(i, v, "x") for i, v in zip(ids, good, strict=True)] + [(50, None, "x"), (51, [1.0, None, 2.0], "x"), (52, [1.0, float("-inf"), 2.0], "x"), (53, [1.0], "x"), (54, [], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    out = centroids.cluster(df, dims=3, clusters=4, rounds=5).collect()
    x = [[int(np.floor(1024 * c)) for c in v] for v in good]
    own, shas = clustered_by_hand(ids, x, 4, 5)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in out), key=key) == sorted(((i, k, d, shas[k]) for i, (k, d) in zip(ids, own, strict=True)), key=key)
    total = {}
    for k, d in own:
        total[k] = total.get(k, 0) + d
    assert all(r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) for r in out)
    few = centroids.cluster(df.where("vec_id IN (1, 2)"), dims=3, clusters=8).collect()
    assert len(few) == 2 and all(r.distance == 0 for r in few)
    assert centroids.cluster(df.limit(0), dims=3).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e6])], "vec_id long, embedding array<double>"), dims=1)


def test_incremental_dots_equal_products_from_scratch():
    from cairnwork.llm import centroids

    rng = np.random.default_rng(6)
    x, a, b = rng.integers(-500, 500, (50, 8)), rng.integers(-500, 500, (4, 8)), rng.integers(-500, 500, (4, 8))
    b[1], b[2, 3:] = a[1], a[2, 3:]
    assert (centroids.changed_dots(x, x @ a.T, b - a) == x @ b.T).all()


def test_samples_are_bounded_in_rows(spark):
    """Many rows of one id don't all go to the task that trains."""
    from cairnwork.llm import quality, tokenstore

    rows = [(7, f"text number {k} of one id", k) for k in range(300)] + [(k, f"other {k}", 0) for k in range(8, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    seen = []

    labels = spark.createDataFrame([(k, k % 2) for k in range(7, 20)] + [(7, 1)] * 5, "doc_id long, quality int")
    for make in (lambda: quality.train(docs, labels, max_train=25), lambda: tokenstore.train_dictionary(docs, "/opt/tokenizers/byte_bpe_50k.json", "doc_id", "text", "H", sample=25)):
        frame = type(docs)
        real = frame.repartition
        frame.repartition = lambda self, *a, real=real: seen.append(self.count()) or real(self, *a)
        try:
            make()
        finally:
            frame.repartition = real
    assert seen == [25, 25]


def test_freed_memory_goes_back_to_the_system(monkeypatch):
    """Many small arrays with a few that stay between them, as training leaves them; a memo gives its room back once."""
    import re
    from pathlib import Path

    from cairnwork.llm import common, tokens

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    made = [np.ones(1600) for _ in range(8000)]
    kept = made[::400]
    del made
    before = held()
    common.give_back()
    assert before - held() > 50 and len(kept) == 20

    calls = []
    monkeypatch.setattr(tokens, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(tokens, "_encoders", {})
    encoder = tokens.encoder("/opt/tokenizers/word_bpe_49k.json", tokens.WordEncoder)
    list(encoder.encode(["some words"]))
    tokens.forget()
    tokens.forget()
    assert calls == [1] and not encoder.memo and not encoder.memo.older
