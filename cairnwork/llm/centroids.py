"""Clustering of embeddings around integer centroids, with an incremental distance matrix.

Method: each vector keeps its exact integer dot products with all centroids, in a table that every round writes anew. When
centroids move, only their components that changed are looked at: dots += x[changed] * change. Distances follow as
|x|² - 2 x·c + |c|², their argmin (ties: the smaller number) assigns the vector, and sums per cluster, made per
block of vectors, give the next centroids: exact floors of sum / count, an empty cluster's stays. What reaches the driver
is clusters x dims sums a round. Rounds end early when no component changes, since all later ones would repeat.

Defined cases: a null vector, one with a null or non-finite entry, or one of another length leaves. Rows with a null id are
clustered and keep it, but start no centroid before all others; rows of one id are vectors each, ties among the starts go by
components. With fewer vectors than clusters there are as many centroids as vectors; an empty table gives no rows.
Components beyond 2^27 (131,072 before scaling) would leave 64-bit arithmetic: ValueError. Inertias beyond a long are
null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import vectorblocks as vb
from cairnwork.llm.common import drop_path, load, store

SCALE, DIMS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
MOST = 1 << 27
STATE = vb.BLOCKS + ", dots binary, sums array<long>"


def starts(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of least sha256("seed:id"), in order."""
    found = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in found], np.int64)


def changed_dots(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """dots after centroids changed by `change` (clusters x dims): only components that moved are multiplied."""
    for k in np.flatnonzero(change.any(1)):
        moved = np.flatnonzero(change[k])
        dots[:, k] += x[:, moved] @ change[k, moved]
    return dots


def nearest(x: np.ndarray, dots: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector; the first minimum wins."""
    partial = norms - 2 * dots
    cluster = partial.argmin(1)
    return cluster, partial[np.arange(len(x)), cluster] + (x * x).sum(1)


def _step(state: DataFrame, change: np.ndarray, norms: np.ndarray, dims: int) -> DataFrame:
    """The state after centroids changed, with each block's sums: per cluster dims sums and a count."""
    clusters = len(norms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots_, sums_ = [], []
            for x, old in zip(vb.unpack(batch, dims), batch.column("dots"), strict=True):
                dots = changed_dots(x, np.frombuffer(old.as_buffer(), "<i8").reshape(-1, clusters).copy(), change)
                cluster, _ = nearest(x, dots, norms)
                sums = np.zeros((clusters, dims + 1), np.int64)
                for k in range(clusters):
                    own = x[cluster == k]
                    sums[k, :dims], sums[k, dims] = own.sum(0), len(own)
                dots_.append(dots.astype("<i8").tobytes())
                sums_.append(sums.ravel())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in vb.NAMES], pa.array(dots_, pa.binary()), pa.array(sums_, pa.list_(pa.int64()))], names=[*vb.NAMES, "dots", "sums"])

    return state.select(*vb.NAMES, "dots").mapInArrow(run, STATE)


def _begin(blocks: DataFrame, clusters: int, dims: int) -> DataFrame:
    """A state without centroids yet: all dot products are 0, and centroids change from 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in vb.unpack(batch, dims):
                if x.size and max(-int(x.min()), int(x.max())) > MOST:
                    raise ValueError(f"a component is beyond {MOST}")
            zero = [bytes(8 * clusters * n) for n in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(zero, pa.binary())], names=[*vb.NAMES, "dots"])

    return blocks.mapInArrow(run, f"{vb.BLOCKS}, dots binary")


def _assigned(state: DataFrame, change: np.ndarray, norms: np.ndarray, dims: int) -> DataFrame:
    clusters = len(norms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in enumerate(vb.unpack(batch, dims)):
                dots = changed_dots(x, np.frombuffer(batch.column("dots")[k].as_buffer(), "<i8").reshape(-1, clusters).copy(), change)
                cluster, distance = nearest(x, dots, norms)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return state.select(*vb.NAMES, "dots").mapInArrow(run, "vec_id long, cluster int, distance long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per kept vector."""
    spark = df.sparkSession
    rows = vb.integers(df, id_col, vector_col, scale).where(F.size("x") == dims)
    centres = starts(rows, clusters, seed)
    if not len(centres):
        return spark.createDataFrame([], RESULT)
    change = centres
    state, path = store(_begin(vb.blocks(rows, dims), len(centres), dims), "dots")
    for _ in range(rounds):
        after, new_path = store(_step(state, change, (centres * centres).sum(1), dims), "dots")
        drop_path(spark, path)
        state, path = after, new_path
        found = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()  # clusters x (dims + 1) rows
        sums = np.zeros(centres.size + len(centres), np.int64)
        for r in found:
            sums[r["at"]] = r["s"]
        sums = sums.reshape(len(centres), dims + 1)
        count = sums[:, dims:]
        moved = np.where(count > 0, sums[:, :dims] // np.maximum(count, 1), centres)
        change, centres = moved - centres, moved
        if not change.any():
            break
    done, _ = store(_assigned(state, change, (centres * centres).sum(1), dims), "clusters")
    drop_path(spark, path)
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    fits = lambda v: v if v < 1 << 63 else None
    facts = [(k, fits(inertia.get(k, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centres)]
    return done.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED) -> str:
    """Every round written out, distances from scratch."""
    near = "(SELECT r, c, sum((l.v - m.v) * (l.v - m.v)) AS d FROM long l JOIN c{0} m USING (k) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1"
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS k, unnest(x) AS v FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < {clusters}))",
        f"long AS MATERIALIZED (SELECT r, unnest(range({dims})) AS k, unnest(x) AS v FROM kept)",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, c FROM {near.format(i)})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT c, k, sum(v)::BIGINT AS s, count(*) AS n FROM a{i} JOIN long USING (r) GROUP BY c, k)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT m.c, m.k, CASE WHEN n IS NULL THEN m.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{i} m LEFT JOIN s{i} ON s{i}.c = m.c AND s{i}.k = m.k)")
    parts.append(f"done AS MATERIALIZED (SELECT r, c, d FROM {near.format(rounds)})")
    parts.append(f"sha AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY k)) AS h FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, done.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY done.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM done JOIN kept USING (r) JOIN sha ON sha.c = done.c"""


ORACLE_SQL = _sql()
