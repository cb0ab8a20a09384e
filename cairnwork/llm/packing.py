"""Best-fit packing of token pieces into sequences under several capacities.

Method: vector best-fit. A sequence has capacities for tokens, documents and attention cost (a piece of n tokens
costs n * n). Pieces come in order of falling size; of the open sequences that can take a piece under every
capacity, the one with the best score gets it: the least weighted norm of what would stay free ("norm"), or the
greatest weighted dot product of the piece's demand with what is free ("dot"). Otherwise a new sequence opens.

Pieces are dealt by hash into groups of about GROUP_PIECES, whose number grows with the input, and each group is
packed by itself. A group leaves at most about one sequence partly filled, so that dividing costs some 1 in 1000 sequences.

Defined cases: null text counts as empty and is packed as its end id alone; null ids are passed through; repeated rows are packed
each; an empty table gives no rows; ties go to the sequence opened first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import tokens
from cairnwork.llm.common import load, ship, store

GROUP_PIECES = 16_384
END_ID = 1


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    score: str = "norm"


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    limit = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    free = np.empty((256, 3))
    used = np.zeros(256, np.int64)
    opened = 0
    live = np.zeros(0, np.int64)  # open sequences that can still take the smallest piece
    least = lengths.min() if n else 0
    # rows of equal length meet the same capacities; a stable order makes reruns equal
    for i in np.argsort(-lengths, kind="stable"):
        demand = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        place = -1
        if len(live):
            rest = free[live] - demand
            fits = (rest >= 0).all(1)
            if fits.any():
                at = live[fits]
                if capacity.score == "dot":
                    place = at[np.argmax((free[at] / limit * (demand / limit) * weights).sum(1))]
                else:
                    place = at[np.argmin(((rest[fits] / limit) ** 2 * weights).sum(1))]
        if place < 0:
            if opened == len(used):
                free = np.concatenate([free, np.empty_like(free)])
                used = np.concatenate([used, np.zeros_like(used)])
            place, opened = opened, opened + 1
            free[place] = limit
            live = np.append(live, place)
        bins[i], offsets[i] = place, used[place]
        used[place] += lengths[i]
        free[place] -= demand
        if free[place, 0] < least or free[place, 1] < 1:
            live = live[live != place]
    return bins, offsets


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """Each document's ids (its tokens, then end_id) cut into pieces of at most size ids; with_ids adds them as an array."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = tokens.encoder(path, tokens.WordEncoder), np.uint32(end_id).tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, np.uint32)] if with_ids else ())))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)] if rows else [pa.array([], k) for k in kinds[: len(names)]], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(cut: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """cut (doc_id, piece, length, ids_crc32 and more columns) with sequence_id and offset."""
    ship(cut.sparkSession)
    groups = max(1, round(cut.count() / GROUP_PIECES))
    key = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)).alias("group")
    order = ["doc_id", "piece", "ids_crc32"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", na_position="last").reset_index(drop=True)
        bins, offsets = best_fit(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=rows["group"] * (1 << 32) + bins, offset=offsets).drop(columns="group")

    kept = [f for f in cut.columns if f not in ("sequence_id", "offset", "group")]
    schema = cut.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    return cut.select(*kept, key).groupBy("group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row per piece."""
    cut, _ = store(pieces(docs, path, capacity.tokens, id_col, text_col, with_ids), "pieces")
    return pack(cut, capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
