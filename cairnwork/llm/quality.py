"""Quality classifier: supervised subword embeddings.

Method: the features of a document are hashed buckets of (a) its words, (c) its byte 3-grams and (d) 5-grams, which go over the
ends of words, and as an addition to the method (b) its words' repetition (how often the word stood there before, by powers of two,
and whether it equals the last word). Every bucket
has a learned vector; a document's vector is the mean, over the four families, of the family's mean vector; a
softmax layer gives the classes' probabilities. Vectors and layer are learned together by stochastic gradient
descent (AdaGrad steps) in numpy. As mean and layer are linear, scoring folds them to one number per bucket: the
whole text is read, and no text is cut.

Training: at most MAX_TRAIN labelled rows (a documented bound: those with the least hash of doc_id), never rows whose
crc32(doc_id as text) mod 3 is 1. It runs in one Spark task over that bounded sample; what comes to the driver and
goes out as a broadcast is the folded table, 4 bytes x 2^18 buckets = 1 MB at any input size.

Defined cases: null text counts as empty; an empty text has no features, its score is the layer's bias alone. A very long text is scored whole. A null
doc_id is not held out and never trains. Without any labelled row (or with one class only) each score is that
class's share, 0.5 where there is none. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import textarrays as ta
from cairnwork.llm import tokens
from cairnwork.llm.common import give_back, load, ship

BITS = 18
DIMENSIONS = 8
MAX_TRAIN = 4000
#: Rows that training sees, repeats counted: few labelled rows get more epochs (6 to 80).
SEEN = 28_000
BATCH = 32
RATE = 0.2
FAMILIES = 4


def _bucket(x: np.ndarray, family: int) -> np.ndarray:
    return (ta.mix(x + np.uint64(family * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(data: np.ndarray, offsets: np.ndarray, n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams that lie within a text, and the number of them before each text."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    key = data[:m].astype(np.uint64)
    for k in range(1, n):
        key = (key << np.uint64(8)) | data[k : k + m]
    inside = np.ones(len(data), bool)
    for k in range(1, n):
        inside[np.maximum(offsets[1:] - k, 0)[offsets[1:] - k >= offsets[:-1]]] = False
    inside = inside[:m]
    key = (key + np.uint64(family)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=before[1 : m + 1])
    before[m + 1 :] = before[m]
    return bucket[inside], before[offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family: buckets, text after text, and n + 1 offsets of the texts."""
    start, end, text = ta.words(data, offsets)
    h = ta.hashes(data, start, end)
    at = np.searchsorted(text, np.arange(len(offsets)))
    yield _bucket(h, 1), at
    order = np.lexsort((h, text))
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.flatnonzero(~same)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h)) - np.repeat(run, np.diff(np.r_[run, len(h)]))
    last = np.zeros(len(h), bool)
    last[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    yield _bucket((np.minimum(np.log2(rank + 1).astype(np.uint64), np.uint64(8)) << np.uint64(1)) + last.astype(np.uint64), 2), at
    yield _grams(data, offsets, 3, 3)
    yield _grams(data, offsets, 5, 4)


def scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 of each text, from the folded table."""
    z = np.full(len(offsets) - 1, bias)
    for bucket, at in features(data, offsets):
        total = np.zeros(len(bucket) + 1)
        np.cumsum(table[bucket], out=total[1:], dtype=np.float64)
        n = np.diff(at)
        z += (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1) / FAMILIES
    return 1 / (1 + np.exp(-z))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Vectors, layer and bias by stochastic gradient descent; texts are byte arrays."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    if not len(labels) or share.max() == 1:
        bias[1] = np.log(max(share[1], 1e-3) / max(share[0], 1e-3)) if len(labels) else 0
        return {"vectors": np.zeros_like(vectors), "layer": layer, "bias": bias}
    rows = []
    for t in texts:  # each document's buckets with their weights
        idx, weight = [], []
        for bucket, _ in features(t, np.array([0, len(t)])):
            b, c = np.unique(bucket, return_counts=True)
            idx.append(b.astype(np.int32))
            weight.append(c / max(len(bucket), 1) / FAMILIES)
        idx, weight = np.concatenate(idx), np.concatenate(weight).astype(np.float32)
        rows.append((idx, weight))
    epochs = min(80, max(6, -(-SEEN // len(rows))))
    g_vectors, g_layer, g_bias = np.full(1 << BITS, 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            idx = np.concatenate([rows[i][0] for i in part])
            weight = np.concatenate([rows[i][1] for i in part])
            size = np.array([len(rows[i][0]) for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            held = np.zeros((len(part), DIMENSIONS), np.float32)
            full = size > 0
            if len(idx):
                held[full] = np.add.reduceat(vectors[idx] * weight[:, None], (np.cumsum(size) - size)[full])
            logits = held @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1  # gradient of the logits
            p /= len(part)
            down = p @ layer.T
            for value, grown, gradient in ((layer, g_layer, held.T @ p), (bias, g_bias, p.sum(0))):
                grown += gradient**2
                value -= rate * gradient / np.sqrt(grown)
            if len(idx):
                by = np.argsort(idx, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(idx[by]) != 0])
                gradient = np.add.reduceat(down[doc[by]] * weight[by, None], first)
                touched = idx[by][first]
                g_vectors[touched] += (gradient**2).mean(1)
                vectors[touched] -= rate * gradient / np.sqrt(g_vectors[touched])[:, None]
    return {"vectors": vectors, "layer": layer, "bias": bias}


def fold(model: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """One number per bucket: the difference of the classes' logits that its vector makes."""
    by_class = model["layer"][:, 1] - model["layer"][:, 0]
    return (model["vectors"] @ by_class).astype(np.float32), float(model["bias"][1] - model["bias"][0])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """The folded table and bias, fitted on at most max_train labelled rows."""
    ship(docs.sparkSession)
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    sample = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)  # at most max_train ids: a bounded broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # repeated ids or labels don't widen the sample: max_train rows go to the one task, whatever ids they have
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "label").limit(max_train)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()  # what other stages remember in this worker takes room from this one
        rows = [(i, label, t) for b in batches for i, t, label in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("label").to_pylist(), strict=True)]
        rows.sort()  # the same model, in whatever order tasks deliver
        table, bias = fold(fit([np.frombuffer(t, np.uint8) for _, _, t in rows], np.array([x for _, x, _ in rows], np.int64)))
        out = io.BytesIO()
        np.savez_compressed(out, table=table, bias=bias)
        del rows
        give_back()  # the features of all samples: many small arrays, which the worker would hold while later stages run
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    made = texts.repartition(1).mapInArrow(run, "model binary").collect()
    if not made:  # a table without partitions
        return np.zeros(1 << BITS, np.float32), 0.0
    found = np.load(io.BytesIO(made[0][0]))
    return found["table"], float(found["bias"])


def classify(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """docs with a column score (probability of label 1); a column of that name is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        tokens.forget()
        table, bias = shared.value
        out = np.empty(len(column))
        for a, b, data, offsets in ta.parts(column):
            out[a:b] = scores(data, offsets, table, bias)
        give_back()
        return pa.array(out, pa.float64())

    return docs.withColumn("score", score(F.col(text_col).cast("string")))


def predicted(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = classify(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return predicted(docs, train(docs, load(spark, sf_dir, "labels")))
