"""Exact nearest neighbours within a class, by metric partitions (Lu et al., 2012).

Each class has pivots, rows picked by hash; a row belongs to the part of its nearest pivot. From the parts' radii and each part's
few rows nearest to its pivot follows a bound on the distance of the k-th neighbour of anything in a part. A row meets
a part only if the triangle inequality lets it be as near as that: what is left out can't be a neighbour. Parts and the rows
that meet them are dealt to blocks of bounded size, a task compares one block with another and keeps the k best a row, and the
blocks' bests are merged. So no task holds a class, copies of one vector are split like anything else, and no
pair of rows passes a shuffle. Where distances hardly differ (many dimensions of noise) bounds leave little out: the work is then that
of comparing all, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.batches import matrix
from cairnwork.functions.hashing import hashed_rank, order_key
from cairnwork.sources.shipping import ship

#: Bounds are widened by this share, so that rounding leaves nobody out.
SLACK = 1e-9
#: Distances held at once while two blocks are compared.
BLOCK_PAIRS = 1 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def reach(near: list[list[float]], radius: np.ndarray, between: np.ndarray, k: int) -> np.ndarray:
    """Per part a bound on the distance from any of its rows to its k-th neighbour. near: each part's least distances to its pivot, the row's own
    included, at least k + 1 of them where there are as many."""
    out = np.full(len(radius), np.inf)
    for i in range(len(radius)):
        bounds = np.sort(np.concatenate([radius[i] + between[i, j] + np.array(n) for j, n in enumerate(near) if n]))
        if len(bounds) > k:  # one of them may be the row itself
            out[i] = bounds[k]
    return out


def best(a: np.ndarray, ka: np.ndarray, b: np.ndarray, kb: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(row of a, row of b, squared distance) of the k nearest in b of each row of a that has another key; ties to the lesser key."""
    order = pd.Series(kb).rank(method="dense").to_numpy()  # keys of any kind, as numbers
    step = max(1, BLOCK_PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        rough = (part * part).sum(1)[:, None] + (b * b).sum(1) - 2 * part @ b.T
        rough[ka[at : at + step, None] == kb] = np.inf
        kth = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        slack = 1e-9 * ((part * part).sum(1) + (b * b).sum(1).max())
        for i, row in enumerate(rough):
            found = np.flatnonzero(row <= kth[i] + slack[i]) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(row))
            d2 = ((b[found] - part[i]) ** 2).sum(1)
            for j in np.lexsort((order[found], d2))[:k]:
                yield at + i, int(found[j]), float(d2[j])


def nearest(df: DataFrame, key: str, features: str, label: str, k: int, chunk: int, most_pivots: int) -> DataFrame:
    """label, key, neighbour, d2, r: see rebalance.nearest."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(label).alias("class"), F.col(key).alias("key"), F.col(features).alias("v")).where(F.col("v").isNotNull() & F.col("class").isNotNull())
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("class", "key")}
    sizes = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}  # a row a class
    want = spark.createDataFrame([(c, min(most_pivots, max(1, -(-n // chunk)))) for c, n in sizes.items()], f"class {kinds['class']}, most int")
    picked = hashed_rank(rows.join(F.broadcast(want), "class"), ["class"], order_key(0, "key"), "place").where("place <= most")
    pivots: dict = {}
    for r in picked.select("class", "place", "v").orderBy("class", "place").collect():  # at most most_pivots rows a class
        pivots.setdefault(r["class"], []).append(r["v"])
    pivots = {c: np.array(p, float) for c, p in pivots.items()}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, v = np.array(batch.column("class").to_pylist()), matrix(batch.column("v"))
            part, far = np.zeros(len(of), np.int32), np.zeros(len(of))
            for c in np.unique(of):
                own = of == c
                d = distances(v[own], pivots[c.item()])
                part[own], far[own] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(far)], names=["class", "key", "v", "part", "far"])

    placed = rows.mapInArrow(place, f"class {kinds['class']}, key {kinds['key']}, v array<double>, part int, far double")
    ranked = placed.select("class", "part", "far").withColumn("r", F.row_number().over(W.partitionBy("class", "part").orderBy("far"))).where(F.col("r") <= k + 1)
    near = ranked.groupBy("class", "part").agg(F.collect_list("far").alias("near"))  # k + 1 numbers a part
    facts = placed.groupBy("class", "part").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(near, ["class", "part"]).collect()  # a row a part
    radius, bound, blocks = {}, {}, {}
    for c, p in pivots.items():
        own = {r["part"]: r for r in facts if r["class"] == c}
        radius[c] = np.array([own[i]["radius"] if i in own else 0.0 for i in range(len(p))])
        bound[c] = reach([own[i]["near"] if i in own else [] for i in range(len(p))], radius[c], distances(p, p), k)
        blocks[c] = np.array([-(-own[i]["n"] // chunk) if i in own else 0 for i in range(len(p))])  # 0: nobody asks
    others = {c: -(-n // chunk) for c, n in sizes.items()}

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the parts that they may be neighbours in."""
        for batch in batches:
            of, v = batch.column("class").to_pylist(), matrix(batch.column("v"))
            found = [[]] * len(of)
            for c in set(of):
                own = [i for i, x in enumerate(of) if x == c]
                d = distances(v[own], pivots[c])
                scale = SLACK * (1 + d.max(initial=0.0))
                may = (d - radius[c] <= bound[c] * (1 + SLACK) + scale) & (blocks[c] > 0)
                for i, m in zip(own, may, strict=True):
                    found[i] = [(int(p), int(blocks[c][p])) for p in np.flatnonzero(m)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32())])))], names=["class", "key", "v", "parts"])

    spread = spark.createDataFrame([(c, int(n)) for c, n in others.items()], f"class {kinds['class']}, n int")
    asks = placed.join(F.broadcast(spread), "class")  # a row a class
    asked = spark.createDataFrame([(c, i, int(n)) for c, b in blocks.items() for i, n in enumerate(b)], f"class {kinds['class']}, part int, m int")
    asks = asks.join(F.broadcast(asked), ["class", "part"]).withColumn("ask", F.pmod(F.xxhash64("key"), "m").cast("int")).withColumn("answer", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("class", "part", "ask", "answer", "key", "v")
    answers = rows.select("class", "key", F.col("v").cast("array<double>").alias("v")).mapInArrow(meet, f"class {kinds['class']}, key {kinds['key']}, v array<double>, parts array<struct<part:int,n:int>>")
    answers = answers.join(F.broadcast(spread), "class").withColumn("answer", F.pmod(F.xxhash64("key", F.lit(1)), "n").cast("int")).withColumn("p", F.explode("parts"))
    answers = answers.select("class", F.col("p.part").alias("part"), F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("ask"), "answer", "key", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        ka, kb = (t.column("key").to_numpy() for t in (left, right))
        va, vb = (matrix(t.column("v").combine_chunks()) for t in (left, right))
        found = list(best(va, ka, vb, kb, k)) if len(ka) and len(kb) else []
        i, j, d2 = (pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [()] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True))
        return pa.table({"class": left.column("class").take(i), "key": left.column("key").take(i), "neighbour": right.column("key").take(j), "d2": d2})

    by = ["class", "part", "ask", "answer"]
    found = asks.groupBy(*by).cogroup(answers.groupBy(*by)).applyInArrow(compare, f"class {kinds['class']}, key {kinds['key']}, neighbour {kinds['key']}, d2 double")
    merged = found.withColumn("r", F.row_number().over(W.partitionBy("class", "key").orderBy("d2", "neighbour"))).where(F.col("r") <= k)
    return merged.select(F.col("class").alias(label), F.col("key").alias(key), "neighbour", "d2", "r")
