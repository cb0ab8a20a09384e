"""Exact deduplication by Grace hashing.

Method: copies inside one input split collapse first, in an open-addressing table that compares complete
content, so that a text which holds a third of all rows leaves each split once. The survivors are dealt by a
content hash (the first partitioning, done by Spark's shuffle); a task whose share doesn't fit its memory
budget partitions it again, with another hash seed, to spill files in the task's temporary folder, until each
bucket fits such a table. Files live only as long as the task; a lost executor's tasks just run again.

Defined cases: null text counts as empty, so empty and null texts are copies of each other. A null doc_id is
larger than any other; where all ids of a group are null, keep_id is null. Of repeated rows (same id and text)
one stays. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.common import as_bytes, load, ship, store

#: Bytes of distinct content that one task holds at a time.
MEMORY_BYTES = 96 << 20
FAN_OUT = 16
#: Greater than any document id; stands for a null one.
NO_ID = (1 << 63) - 1
SPACE = b" \t\n\x0b\x0c\r"


def normalise(text: bytes | None) -> bytes:
    r"""Each run of [\x20\x09-\x0D] becomes one space."""
    if not text:
        return b""
    body = b" ".join(text.split())  # bytes.split() splits at exactly these six characters
    if not body:
        return b" "
    return (b" " if text[0] in SPACE else b"") + body + (b" " if text[-1] in SPACE else b"")


class ContentTable:
    """Open addressing with linear probing; slots hold entry numbers, and a probe compares hash, then complete content."""

    def __init__(self, capacity: int = 1 << 10) -> None:
        self.slots = [-1] * capacity
        self.mask = capacity - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def _place(self, h: int, entry: int) -> None:
        i = h & self.mask
        while self.slots[i] >= 0:
            i = (i + 1) & self.mask
        self.slots[i] = entry

    def find_or_add(self, content: bytes) -> tuple[int, bool]:
        """The entry's number, and whether it is new."""
        h = hash(content)
        i = h & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & self.mask
        entry = len(self.contents)
        self.slots[i] = entry
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            self.mask = len(self.slots) - 1
            for k, old in enumerate(self.hashes):
                self._place(old, k)
        return entry, True


MEMBERS = "doc_id long, rep long, first boolean, content binary, low long, n long"


def _members(schema_rows: tuple) -> pa.RecordBatch:
    ids, reps, firsts, contents, lows, counts = schema_rows
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), pa.array(firsts, pa.bool_()), pa.array(contents, pa.binary()), pa.array(lows, pa.int64()), pa.array(counts, pa.int64())],
        names=["doc_id", "rep", "first", "content", "low", "n"],
    )


def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its local representative; the row of the least id carries content, least id and count.

    Column 2 of the input numbers the rows of the whole table (monotonically_increasing_id).
    """
    table, ids, numbers, entries = ContentTable(), [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal table, ids, numbers, entries
        if not ids:
            return
        entry = np.array(entries)
        keys = np.array([NO_ID if x is None else x for x in ids])
        order = np.lexsort((np.arange(len(keys)), keys, entry))
        start = np.flatnonzero(np.r_[True, np.diff(entry[order]) != 0])
        lead = order[start]  # of each entry, the row with the least id
        rep_of = np.array(numbers)[lead]
        first = np.zeros(len(keys), bool)
        first[lead] = True
        count = np.bincount(entry)
        step = 2000
        for at in range(0, len(keys), step):
            part = range(at, min(at + step, len(keys)))
            yield _members((
                [ids[i] for i in part], [int(rep_of[entry[i]]) for i in part], [bool(first[i]) for i in part],
                [table.contents[entry[i]] if first[i] else None for i in part],
                [int(keys[i]) if first[i] else None for i in part], [int(count[entry[i]]) if first[i] else None for i in part],
            ))
        table, ids, numbers, entries = ContentTable(), [], [], []

    for batch in batches:
        for doc_id, text, number in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            entries.append(table.find_or_add(normalise(text))[0])
            ids.append(doc_id)
            numbers.append(number)
            if table.bytes > MEMORY_BYTES:
                yield from flush()
    yield from flush()


def _dealt(content: bytes, level: int) -> int:
    return hashlib.blake2b(content, digest_size=4, salt=bytes([level])).digest()[0] % FAN_OUT


def grace(records: Iterator[tuple], memory: int = MEMORY_BYTES, level: int = 0) -> Iterator[tuple]:
    """(rep, content, low, n) -> (rep, keep_rep, keep_id, group_size, sha256), whatever the number of records."""
    held, size, over = [], 0, False
    for r in records:
        held.append(r)
        size += len(r[1]) + 200
        if size > memory:
            over = True
            break
    if not over or level >= 6:  # so deep, a bucket holds copies of few texts; the table keeps each text once
        table, members, best = ContentTable(), [], []
        for source in (held, records):
            for rep, content, low, n in source:
                entry, new = table.find_or_add(content)
                if new:
                    best.append([low, rep, 0])
                b = best[entry]
                if (low, rep) < (b[0], b[1]):
                    b[0], b[1] = low, rep
                b[2] += n
                members.append((rep, entry))
        digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
        for rep, entry in members:
            low, keep_rep, n = best[entry]
            yield rep, keep_rep, None if low == NO_ID else low, n, digests[entry]
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        names = [f"{folder}/{k}" for k in range(FAN_OUT)]
        files = [open(x, "wb") for x in names]  # noqa: SIM115
        for source in (held, records):
            for r in source:
                pickle.dump(r, files[_dealt(r[1], level)], protocol=5)
        held.clear()
        for f in files:
            f.close()
        for name in names:
            with open(name, "rb") as f:
                def read(f=f) -> Iterator[tuple]:
                    while True:
                        try:
                            yield pickle.load(f)  # noqa: S301 - written by this task a moment ago
                        except EOFError:
                            return
                yield from grace(read(), memory, level + 1)


def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)

    out = []

    def batch(rows: list) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "keep_rep", "keep_id", "group_size", "text_sha256"])

    for row in grace(records()):
        out.append(row)
        if len(out) >= 8192:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("number"))
    members, _ = store(rows.mapInArrow(collapse, MEMBERS), "dedup-members")
    # Many splits hold a hot text; each sends it once.
    texts = members.where(F.col("content").isNotNull()).select("rep", "content", "low", "n")
    groups = texts.repartition(F.xxhash64("content")).mapInArrow(resolve, "rep long, keep_rep long, keep_id long, group_size long, text_sha256 string")
    # At most one split's rows share a rep, so that no key of this join grows with the table.
    return members.select("doc_id", "rep", "first").join(groups, "rep").select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("rep") == F.col("keep_rep"))).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
