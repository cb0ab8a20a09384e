"""Token ids in files: each document compressed by itself, with one dictionary for all.

Method: a zstandard dictionary is trained on the serialized id arrays of a bounded sample (SAMPLE documents, those
with the least hash of doc_id); each document's ids are compressed separately with it. Documents stand in order of
doc_id in blocks of about BLOCK_BYTES: one row of the `blocks` table holds the frames one after another, their byte
offsets (the offset index), the documents' ids and token counts, and the dictionary's SHA-256. A frame is read by
its offsets alone, so that a short document costs one small read and one decompression. `manifest` has the number of
tokens before each part, `dictionary` the dictionary itself. All three are Parquet tables, which Spark writes to and
reads from any store.

Ids are serialized as little-endian unsigned 16-bit integers where the vocabulary fits, else 32-bit.

Defined cases: null text counts as empty and holds the end id alone; null ids stand before all others; rows of equal
id follow each other in some fixed order; an empty table gives empty files and no rows. A sample too small to train
on becomes the dictionary as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.llm import tokens
from cairnwork.llm.common import drop_path, load, new_path, scratch, ship, store

SAMPLE = 2000
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 3
END_ID = 0
#: Pieces of text that a worker remembers, twice.
MEMO_PIECES = 300_000


def _ids(texts: list, path: str, end_id: int, code: str) -> Iterator[bytes]:
    """Each text's serialized ids, the end id behind them."""
    end = array(code, [end_id]).tobytes()
    for ids in tokens.encoder(path, tokens.ByteEncoder, code, MEMO_PIECES).encode(texts):
        yield ids + end


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little to train on the samples' last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def train_dictionary(docs: DataFrame, path: str, id_col: str, text_col: str, code: str, sample: int = SAMPLE, end_id: int = END_ID) -> bytes:
    ids = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")  # at most SAMPLE ids
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)  # and as many rows, where ids repeat

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(x for b in batches for x in _ids(b.column("text").to_pylist(), path, end_id, code))
        yield pa.RecordBatch.from_arrays([pa.array([dictionary_of(samples)], pa.binary())], names=["dictionary"])

    made = texts.repartition(1).mapInArrow(run, "dictionary binary").collect()
    return bytes(made[0][0]) if made else b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


BLOCKS = "part int, block int, first_id long, last_id long, n_tokens long, dictionary string, doc_ids array<long>, counts array<int>, offsets array<int>, frames binary"


def write(docs: DataFrame, target: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: int | None = None) -> None:
    """Writes blocks, manifest and dictionary under target; vocabulary: the number of ids, None takes the tokenizer's."""
    spark = docs.sparkSession
    ship(spark)
    code = "H" if max(vocabulary or tokens.vocabulary(path), end_id + 1) <= 1 << 16 else "I"
    width = array(code).itemsize
    trained = train_dictionary(docs, path, id_col, text_col, code, end_id=end_id)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained), width)], "dictionary string, content binary, width int").coalesce(1).write.parquet(f"{target}/dictionary")

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _dictionary(trained)
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False) if held else zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            counts, frames = [], []
            for ids in _ids(batch.column(1).to_pylist(), path, end_id, code):
                counts.append(len(ids) // width)
                frames.append(z.compress(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(frames, pa.binary())], names=["doc_id", "n", "frame"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded, scratch = store(source.mapInArrow(compress, "doc_id long, n int, frame binary"), "frames")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = (part, number, min(known, default=None), max(known, default=None), sum(counts), name, ids, counts, np.cumsum([0, *map(len, frames)]), b"".join(frames))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "block", "first_id", "last_id", "n_tokens", "dictionary", "doc_ids", "counts", "offsets", "frames"])

        for batch in batches:
            for i, n, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, counts, frames, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    # Ranges of ids, in order, become parts; rows of one id may be dealt to several by the further columns.
    ordered = encoded.repartitionByRange(F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("frame")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{target}/blocks")
    drop_path(spark, scratch)
    # one row a part, as many as the write had partitions
    totals = spark.read.schema(BLOCKS).parquet(f"{target}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).coalesce(1).write.parquet(f"{target}/manifest")


def _decoder(spark: SparkSession, target: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{target}/dictionary").first()
    if hashlib.sha256(bytes(row.content)).hexdigest() != row.dictionary:
        raise ValueError("the dictionary is damaged")
    return row.dictionary, bytes(row.content), row.width


def read(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""
    ship(spark)
    name, content, size = _decoder(spark, target)
    width = np.uint16 if size == 2 else np.uint32
    blocks = spark.read.schema(BLOCKS).parquet(f"{target}/blocks")
    # a row a block: the window sees the lengths only, not the frames
    lengths = blocks.select("part", "block", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = lengths.join(spark.read.parquet(f"{target}/manifest"), "part").select("part", "block", (F.col("base") + F.col("inside")).alias("start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _dictionary(content)
        z = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
        for batch in batches:
            if any(x != name for x in batch.column("dictionary").unique().to_pylist()):
                raise ValueError("a block was written with another dictionary")
            for k in range(batch.num_rows):
                doc_ids, counts, offsets = (batch.column(c)[k].values for c in ("doc_ids", "counts", "offsets"))
                frames, at, lengths = batch.column("frames")[k].as_buffer(), offsets.to_numpy(), counts.to_numpy()
                frames = memoryview(frames)
                crcs, ids_of = [], []
                for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), lengths.tolist(), strict=True):
                    ids = np.frombuffer(z.decompress(frames[a:b], max_output_size=n * size), width)
                    if len(ids) != n:
                        raise ValueError("a frame doesn't hold the ids that the index names")
                    crcs.append(zlib.crc32(ids.astype("<u4")))
                    if with_ids:
                        ids_of.append(ids.astype(np.int32))
                starts = batch.column("start")[k].as_py() + np.cumsum(lengths, dtype=np.int64) - lengths
                columns = [doc_ids, pa.array(starts, pa.int64()), counts.cast(pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids_of, pa.list_(pa.int32()))] * with_ids, names=names)

    return blocks.join(base, ["part", "block"]).select("dictionary", "doc_ids", "counts", "offsets", "frames", "start").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_document(spark: SparkSession, target: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: the block's ranges are pushed to the scan, and only their frames are decompressed."""
    _, content, size = _decoder(spark, target)
    held = _dictionary(content)
    z = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda k: F.element_at("doc_ids", k + 1) == doc_id)).alias("k")
    found = spark.read.schema(BLOCKS).parquet(f"{target}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("*", at)
    frame = found.select(F.element_at("counts", F.col("k") + 1).alias("n"), F.expr("substring(frames, offsets[k] + 1, offsets[k + 1] - offsets[k])").alias("frame"))
    return [np.frombuffer(z.decompress(bytes(r.frame), max_output_size=r.n * size), np.uint16 if size == 2 else np.uint32) for r in frame.collect()]


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = new_path(spark, "tokenstore")
    write(load(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"))
    scratch(target)  # the query's result is read from these files; they go when the process ends
    return read(spark, target)
