"""Sequence and mixture models fitted by rounds of Spark aggregations: parameters are small, rows stay where they are."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.functions.batches import matrix, summed
from cairnwork.functions.hashing import hashed_rank, order_key

# ---------------------------------------------------------------- Gaussian mixtures, one a class


def log_density(v: Column, mean: Column, var: Column) -> Column:
    """Diagonal Gaussian."""
    terms = F.zip_with(F.zip_with(v, mean, lambda x, m: (x - m) * (x - m)), var, lambda d2, s: d2 / s + F.log(2 * math.pi * s))
    return -0.5 * A.total(terms)


def component_scores(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with comps: array of (class, comp, lp) for every component, lp = log weight + log density.

    params is classes x components rows, a broadcast whose size is the model's.
    """
    packed = params.agg(F.array_sort(F.collect_list(F.struct("class", "comp", "weight", "mean", "var"))).alias("model"))
    scored = F.transform("model", lambda c: F.struct(c["class"].alias("class"), c["comp"].alias("comp"), (F.log(c["weight"]) + log_density(F.col("v"), c["mean"], c["var"])).alias("lp")))
    return rows.crossJoin(F.broadcast(packed)).withColumn("comps", scored).drop("model")


def components_for(n: int) -> int:
    return min(8, max(2, n // 5))


def fit_gmm(train: DataFrame, key: str, rounds: int = 300, reg: float = 1e-3, most: int = 8, seed: int = 42, tolerance: float = 1e-3) -> DataFrame:
    """params (class, comp, weight, mean, var): expectation maximisation with diagonal covariance, per class.

    A class of n rows has min(most, min(8, max(2, n // 5))) components; means start at rows picked by hash. Tasks add up
    responsibilities of their batches, one array a task comes back each round. A class stops when its mean log-likelihood gains less than tolerance, all after
    `rounds`.
    """
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # a row a class
    spark = train.sparkSession
    kind = train.schema["label"].dataType.simpleString()
    want = spark.createDataFrame([(c, min(most, components_for(n), n)) for c, n in sizes.items()], f"label {kind}, comps int")
    ranked = hashed_rank(train.select(key, "label", "v"), ["label"], order_key(seed, key), "place").join(F.broadcast(want), "label").where("place <= comps")
    spread = train.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg((F.var_pop("x") + reg).alias("s"))
    spread = spread.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda s: s["s"]).alias("var"))
    params: dict = {}
    for r in ranked.join(spread, "label").select("label", "place", "comps", "v", "var").orderBy("label", "place").collect():  # classes x components rows
        params.setdefault(r["label"], []).append((1.0 / r["comps"], r["v"], r["var"]))
    params = {c: tuple(np.array(x, float) for x in zip(*p, strict=True)) for c, p in params.items()}
    rows, going, before = train.select("label", "v").persist(), set(params), {}
    parts = rows.rdd.getNumPartitions()
    for _ in range(rounds):
        now = {c: params[c] for c in params if c in going}
        place, size = {}, 0
        for c, (_, mean, _) in now.items():
            place[c], size = size, size + 1 + len(mean) * (1 + 2 * mean.shape[1])

        def add(total: np.ndarray, batch: pa.RecordBatch, now: dict = now, place: dict = place) -> None:
            of, v = np.array(batch.column("label").to_pylist()), matrix(batch.column("v"))
            for c, (weight, mean, var) in now.items():
                x = v[of == c]
                if not len(x):
                    continue
                # (x - m)^2 / s in parts, so that no rows x components x features array is made
                lp = np.log(weight) - 0.5 * (x * x @ (1 / var).T - 2 * x @ (mean / var).T + (mean * mean / var + np.log(2 * np.pi * var)).sum(1))
                whole = np.logaddexp.reduce(lp, axis=1)
                share = np.exp(lp - whole[:, None])
                k, d = mean.shape
                out = total[place[c] : place[c] + 1 + k * (1 + 2 * d)]
                out[0] += whole.sum()
                out[1 : 1 + k] += share.sum(0)
                out[1 + k : 1 + k + k * d] += (share.T @ x).ravel()
                out[1 + k + k * d :] += (share.T @ (x * x)).ravel()

        sums = summed(rows, size, add, parts)
        for c, (weight, mean, _) in now.items():
            k, d = mean.shape
            own = sums[place[c] : place[c] + 1 + k * (1 + 2 * d)]
            n = own[1 : 1 + k]
            safe = np.maximum(n, 1e-12)[:, None]
            centre = own[1 + k : 1 + k + k * d].reshape(k, d) / safe
            params[c] = (np.maximum(n / sizes[c], 1e-12), centre, np.maximum(own[1 + k + k * d :].reshape(k, d) / safe - centre**2, 0) + reg)
            if c in before and (own[0] - before[c]) / sizes[c] < tolerance:
                going.discard(c)
            before[c] = own[0]
        if not going:
            break
    rows.unpersist()
    made = [(c, k, float(w), m.tolist(), s.tolist()) for c, p in params.items() for k, (w, m, s) in enumerate(zip(*p, strict=True))]
    return spark.createDataFrame(made, f"class {kind}, comp int, weight double, mean array<double>, var array<double>")


def gmm_scores(rows: DataFrame, params: DataFrame, priors: DataFrame) -> DataFrame:
    """rows with scores (array over classes in order): log p(v | class) + log prior. priors: (class, prior)."""
    known = priors.agg(F.array_sort(F.collect_list(F.struct("class", "prior"))).alias("priors"))
    scored = component_scores(rows, params).crossJoin(F.broadcast(known))  # a row

    def score(p: Column) -> Column:
        own = F.filter("comps", lambda c: c["class"] == p["class"])
        return F.when(F.size(own) > 0, A.logsumexp(F.transform(own, lambda c: c["lp"])) + F.log(p["prior"])).otherwise(float("-inf"))

    return scored.withColumn("scores", F.transform("priors", score)).withColumn("classes", F.transform("priors", lambda p: p["class"])).drop("comps", "priors")


def inverse_priors(train: DataFrame) -> DataFrame:
    """class, prior = rows / (classes * rows of the class): it raises rare classes."""
    from cairnwork.operators import rebalance

    return rebalance.class_weights(train, "label").select(F.col("label").alias("class"), F.col("weight").alias("prior"))


def effective_components(params: DataFrame, least: float = 0.01) -> DataFrame:
    return params.where(F.col("weight") > least).groupBy("class").agg(F.count("*").alias("components"))


def save_gmm(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").parquet(path)  # classes x components rows


def load_gmm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- hidden Markov models, one a class


def hmm_init(spark: SparkSession, states: int, stay: float = 0.7) -> DataFrame:
    """i, j, p: start in state 0, stay or move one forward; the last state absorbs."""
    i = spark.range(states).select(F.col("id").cast("int").alias("i"))
    j = spark.range(states).select(F.col("id").cast("int").alias("j"))
    last = F.col("i") == states - 1
    p = F.when((F.col("i") == F.col("j")) & last, 1.0).when(F.col("i") == F.col("j"), stay).when(F.col("j") == F.col("i") + 1, 1 - stay).otherwise(0.0)
    return i.crossJoin(j).select("i", "j", p.alias("p"))  # states squared


#: Numbers in one array of states over time, for sequences side by side.
BATCH_STATES = 1 << 21


def forward_backward(x: np.ndarray, sizes: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray):
    """Of sequences side by side (sequences x time, `sizes` values each count): log-likelihoods, state shares (sequences x time
    x states, 0 behind the end), expected moves of all. A step of time is one operation on all sequences."""
    n, length = x.shape
    there = np.arange(length) < sizes[:, None]
    b = -0.5 * ((x[..., None] - mean) ** 2 / var + np.log(2 * np.pi * var))
    top = b.max(2)
    e = np.where(there[..., None], np.exp(b - top[..., None]), 1.0)
    alpha, scale = np.zeros(e.shape), np.ones((n, length))
    for t in range(length):
        now = (alpha[:, t - 1] @ move if t else start) * e[:, t]
        scale[:, t] = np.where(there[:, t], np.maximum(now.sum(1), 1e-300), 1.0)
        alpha[:, t] = np.where(there[:, t, None], now / scale[:, t, None], 0.0)
    beta = np.ones(e.shape)
    for t in range(length - 2, -1, -1):
        beta[:, t] = np.where(there[:, t + 1, None], (e[:, t + 1] * beta[:, t + 1]) @ move.T / scale[:, t + 1, None], 1.0)
    shares = alpha * beta
    shares /= np.maximum(shares.sum(2, keepdims=True), 1e-300)
    later = np.where(there[:, 1:, None], e[:, 1:] * beta[:, 1:] / scale[:, 1:, None], 0.0)
    moves = move * np.einsum("nti,ntj->ij", alpha[:, :-1], later) if length > 1 else np.zeros(move.shape)
    return np.where(there, np.log(scale) + top, 0.0).sum(1), shares, moves


def side_by_side(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sequences of like length as padded arrays with their sizes: at most as many as fit BATCH_STATES (one at least), none over twice as long as another."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        shortest, end = int(sizes[order[at]]), at + 1
        while end < len(order) and sizes[order[end]] <= 2 * shortest and (end + 1 - at) * int(sizes[order[end]]) * states <= BATCH_STATES:
            end += 1
        own = order[at:end]
        place = np.minimum(np.arange(int(sizes[own].max())), sizes[own][:, None] - 1)
        yield values[starts[own][:, None] + place], sizes[own]
        at = end


def fit_hmm(sequences: DataFrame, states: int = 8, rounds: int = 150, reg: float = 1e-2, tolerance: float = 1e-2) -> tuple[dict, list[dict]]:
    """({class: (start, move, mean, var)}, [{class: log-likelihood} per round]).

    It ends after `rounds`, or as soon as no class gains more than `tolerance`.
    sequences has class and x (array). States are no more than the shortest sequence. Each round sends the
    parameters out; tasks take sequences of like length side by side, and one array of sums a task comes back.
    """
    spark = sequences.sparkSession
    info = sequences.groupBy("class").agg(F.min(F.size("x")).alias("shortest"), F.max(F.array_max("x")).alias("hi"), F.min(F.array_min("x")).alias("lo")).collect()  # a row a class
    params = {}
    for r in info:
        k = max(1, min(states, r["shortest"]))
        move = np.zeros((k, k))
        for row in hmm_init(spark, k).collect():
            move[row["i"], row["j"]] = row["p"]
        start = np.eye(k)[0]
        lo, hi = r["lo"] or 0.0, r["hi"] or 0.0
        width = max(hi - lo, 1.0)
        params[r["class"]] = (start, move, np.linspace(lo, hi, k + 2)[1:-1], np.full(k, (width / 2) ** 2 + reg))
    # a class's sums: log-likelihood, then per state the shares, shares times x, shares times x squared, then moves
    place, size = {}, 0
    for c, p in params.items():
        k = len(p[2])
        place[c], size = size, size + 1 + 3 * k + k * k
    history: list[dict] = []
    rows = sequences.select("class", F.col("x").cast("array<double>").alias("x")).persist()
    parts = rows.rdd.getNumPartitions()
    for _ in range(rounds):

        def add(total: np.ndarray, batch: pa.RecordBatch, current: dict = params) -> None:
            of, x = batch.column("class").to_numpy(zero_copy_only=False), batch.column("x")
            sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = x.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for c, (start, move, mean, var) in current.items():
                own, k, at = of == c, len(mean), place[c]
                for v, n in side_by_side(values, starts[own], sizes[own], k):
                    ll, shares, moves = forward_backward(v, n, start, move, mean, var)
                    total[at] += ll.sum()
                    total[at + 1 : at + 1 + 3 * k] += np.concatenate([np.einsum("nts,nt->s", shares, v**power) for power in range(3)])
                    total[at + 1 + 3 * k : at + 1 + 3 * k + k * k] += moves.ravel()

        sums = summed(rows, size, add, parts)
        history.append({c: float(sums[place[c]]) for c in params})
        if len(history) > 1 and all(ll - history[-2][c] <= tolerance for c, ll in history[-1].items()):
            break
        new = {}
        for c, (start, move, mean, var) in params.items():
            k, at = len(mean), place[c] + 1
            w, wx, wxx = sums[at : at + 3 * k].reshape(3, k)
            moves = sums[at + 3 * k : at + 3 * k + k * k].reshape(k, k)
            seen, whole = w > 1e-8, moves.sum(1, keepdims=True)
            safe = np.where(seen, w, 1.0)
            centre = np.where(seen, wx / safe, mean)
            spread = np.where(seen, np.maximum(wxx / safe - centre**2, 0) + reg, var)
            new[c] = (start, np.where(whole > 1e-12, moves / np.maximum(whole, 1e-12), move), centre, spread)
        params = new
    rows.unpersist()
    return params, history


HMM = "class int, start array<double>, move array<array<double>>, mean array<double>, var array<double>"


def save_hmm(spark: SparkSession, params: dict, path: str) -> None:
    rows = [(int(c), *(x.tolist() for x in p)) for c, p in sorted(params.items())]
    spark.createDataFrame(rows, HMM).coalesce(1).write.mode("overwrite").parquet(path)


def load_hmm(spark: SparkSession, path: str) -> dict:
    return {r["class"]: tuple(np.array(r[k]) for k in ("start", "move", "mean", "var")) for r in spark.read.schema(HMM).parquet(path).collect()}  # a row a class


def hmm_score(sequences: DataFrame, params: dict) -> DataFrame:
    """sequences with scores (log-likelihood per class in order of class) and pred, by the forward recursion on arrays.

    A class without parameters, or an empty sequence, scores -inf.
    """
    scores = []
    for c in sorted(params):
        start, move, mean, var = params[c]
        k = len(mean)
        logs = lambda a: F.array(*[F.lit(float(np.log(v))) if v > 0 else F.lit(-1e300) for v in a])
        emit = lambda x, j: -0.5 * ((x - float(mean[j])) * (x - float(mean[j])) / float(var[j]) + math.log(2 * math.pi * float(var[j])))  # noqa: B023, E731
        columns = [logs(move[:, j]) for j in range(k)]
        first = F.get("x", F.lit(0))
        begin = F.array(*[(F.lit(float(np.log(start[j]))) if start[j] > 0 else F.lit(-1e300)) + emit(first, j) for j in range(k)])
        step = lambda a, x: F.array(*[A.logsumexp(A.added(a, columns[j])) + emit(x, j) for j in range(k)])  # noqa: B023, E731
        whole = A.logsumexp(F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), begin, step))
        scores.append(F.when(F.size("x") > 0, whole).otherwise(float("-inf")))
    labels = F.array(*[F.lit(int(c)) for c in sorted(params)])
    return sequences.withColumn("scores", F.array(*scores)).withColumn("pred", F.get(labels, A.argmax(F.col("scores"))))
