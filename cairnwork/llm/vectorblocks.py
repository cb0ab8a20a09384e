"""Integer vectors in blocks: one row holds up to BLOCK_ROWS of them as bytes, so that a pass costs a read and no conversion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.common import ship

BLOCK_ROWS = 1024
#: Integer types of growing width: a block takes the first that holds it.
KINDS = ("<i2", "<i4", "<i8")
BLOCKS = "ids array<long>, rows int, kind string, x binary"
NAMES = ["ids", "rows", "kind", "x"]


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and x = floor(scale * entry) as longs, of the rows whose vector is finite."""
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows x dims of a column of arrays that all have dims entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def pack(x: np.ndarray) -> tuple[str, bytes]:
    reach = max(-int(x.min()), int(x.max())) if x.size else 0
    kind = next(k for k in KINDS if reach <= np.iinfo(k).max)
    return kind, np.ascontiguousarray(x, kind).tobytes()


def unpack(batch: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    """Each block of a batch as rows x dims longs."""
    for kind, data in zip(batch.column("kind").to_pylist(), batch.column("x"), strict=True):
        yield np.frombuffer(data.as_buffer(), kind).reshape(-1, dims).astype(np.int64)


def blocks(rows: DataFrame, dims: int, with_ids: bool = True) -> DataFrame:
    """rows (vec_id, x) with dims entries each, in blocks; ids are empty where they aren't wanted."""
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            ids = batch.column("vec_id") if with_ids else None
            found = []
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at : at + BLOCK_ROWS]
                found.append((ids[at : at + BLOCK_ROWS].to_pylist() if with_ids else [], len(part), *pack(part)))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.list_(pa.int64()), pa.int32(), pa.string(), pa.binary()), strict=True)], names=NAMES)

    return rows.select(*["vec_id"] * with_ids, "x").mapInArrow(run, BLOCKS)
