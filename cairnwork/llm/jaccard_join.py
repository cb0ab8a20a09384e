r"""N-gram Jaccard join: exact links of texts whose shingle sets are alike, and their components.

A text's set: its distinct n-word shingles (A-Z lower-cased, words split at [\x20\x09-\x0D]+), each a 64-bit hash;
with fewer than n words the whole sequence as one; without words empty, and linked with nothing. Two sets link when
100 * |intersection| >= percent * |union|, that is when they differ in at most (100 - percent) * (a + b) / (100 + percent)
elements, a and b being their sizes.

Method: universe-partition pigeonhole. Sizes are divided into bands that grow by BAND_GROWTH. In band k two sets that
link differ in at most H_k elements. A hash deals the universe to H_k + 1 + E segments, so that two such sets have at
least 1 + E identical segments; each set writes a signature (a hash of segment number and segment content) per segment,
in its own band and, if large enough for partners there, in the next. An empty segment would match every other empty
one, so that empty segments get no signature (they count 0 instead of 1). S spare segments make up for them by
counting 2: those also write the signatures of their one-deletion neighbourhood, so that one difference in
them is found. What counts sum up to stays above H_k while a set has at most E + S empty segments; one that has more
writes all its segments, and two such sets find each other by an identical segment, any other pair by the counts of the
one with fewer empty ones. E and S are allocated per band by least expected cost, see allocate().

Sets that link share 1 + E identical segments less the empty ones at least; a node whose signatures are shared (with any other node)
less often than that has no link in the band, and leaves before anything is compared.

Equal sets collapse to one node first (a 128-bit key; of sets under SMALL elements, a digest of the shingles themselves).
Signatures that several nodes write make buckets. A task sorts what it wrote: a signature that comes twice there is known
to be shared, only its first row has to meet the other tasks' rows, the others are spread by salt.
Round 1 compares every member with its bucket's least node (as many pairs as members) and joins what links. Rounds 2 and 3
deal each bucket that isn't joined yet to chunks, every round to other ones, and verify the nearest pairs of each chunk that would
join its components, fewer than members. Round 4 verifies all pairs left between components:
  - a bucket of at most CHUNK members is one unit of work;
  - in a larger one with at most CHUNK members outside its largest component, those meet each chunk of it: linear in the bucket;
  - any other is split by its members' rare shingles: two sets that link share one of the first n - ceil(percent * n / 100) + 1
    shingles in ascending order of frequency (and t of the first n - ceil(percent * n / 100) + t). Buckets of the least shared
    shingle, then of the least two and so on (LEVELS of them) go the same ways; a family whose members differ enough
    to have shingles of their own leaves at once, in time linear in its shingles. Of the many buckets that two sets share there, the one of
    their first common shingles alone gives the pair, so that it comes once, not once a choice. What is still large behind the
    last level is compared in pairs of chunks, spread over tasks: exact, and the only step that costs a square.
Pairs whose parity sketches differ in more bits than the sets may differ in elements are out (a bound, it loses no link); the others are
verified on complete sets, in the JVM. Components come from rounds of hooking to the least neighbour and pointer jumping, in Spark.

Defined cases: null text counts as empty; a null doc_id never is a component's id unless all ids of the component are null;
repeated rows give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.llm import textarrays as ta
from cairnwork.llm import tokens
from cairnwork.llm.common import give_back, load, mark, release, ship, store

BAND_GROWTH = 1.3
SPARE = 2
#: Percent of extra segments at least: linked sets then have so many identical segments more than one.
LEAST_EXTRA = 15
#: What a compared pair costs, in signatures.
PAIR_COST = 5
#: Nodes of one chunk of a large bucket.
CHUNK = 256
#: Sets below so many elements have a digest of their shingles as key.
SMALL = 8
#: Signatures that a task sorts at once, and salts of those that it knows to be shared.
SORTED, SALTS = 500_000, 64
#: Rare shingles that a bucket's key holds at most.
LEVELS = 3


class Bands:
    """Bands of set sizes for a threshold in percent, and the segments of each band."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.low: list[int] = [1]
        self.segments: list[int] = []  # the least number: one more than sets may differ in
        self.plans: dict[tuple[int, int], tuple[int, int]] = {}

    def _grow(self) -> None:
        k = len(self.segments)
        low = self.low[k]
        # the first band holds the sizes at which only equal sets link
        high = max(low, int(low * BAND_GROWTH)) if k else max(1, -(-(100 + self.percent) // (2 * (100 - self.percent))) - 1 if self.percent < 100 else 1 << 40)
        self.low.append(high + 1)
        self.segments.append(self.differ(high, high) + 1)

    def differ(self, a: int, b: int) -> int:
        """In how many elements sets of these sizes may differ and link."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n elements writes signatures."""
        while self.low[-1] <= n:
            self._grow()
        k = int(np.searchsorted(self.low, n, "right")) - 1
        if k == len(self.segments):
            self._grow()
        return [k] + [k + 1] * (100 * n >= self.percent * self.low[k + 1])

    def count(self, k: int) -> int:
        while len(self.segments) <= k:
            self._grow()
        return self.segments[k]

    def plan(self, k: int, rows: int) -> tuple[int, int]:
        """allocate() of a band, worked out once."""
        if (k, rows) not in self.plans:
            self.plans[k, rows] = allocate(self.low[k], self.count(k) - 1, rows)
        return self.plans[k, rows]


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, tuple[int, int] | None]]:
    """Of each text the sorted distinct shingle hashes and the set's key; None for an empty set."""
    for _, _, data, offsets in ta.parts(column):
        data = ta.LOWER[data]
        start, end, text = ta.words(data, offsets)
        words = ta.hashes(data, start, end)
        at = np.searchsorted(text, np.arange(len(offsets)))
        m = len(words) - n + 1
        mixed = np.zeros(max(m, 0), np.uint64)
        for k in range(n):
            if m > 0:
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
        mixed = ta.mix(mixed)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                items = np.unique(mixed[a : b - n + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(1)
                items = ta.mix(whole)
            else:
                yield np.zeros(0, np.uint64), None
                continue
            if len(items) < SMALL:
                w = [data[x:y].tobytes() for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                shingles = {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
                digest = hashlib.blake2b(b"\n".join(sorted(shingles)), digest_size=16).digest()
                yield items, (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))
            else:
                yield items, (_sum(items * np.uint64(0xD6E8FEB86659FD93)), _sum(items + np.uint64(0x9FB21C651E98DF25)))


def _sum(x: np.ndarray) -> int:
    return int(ta.mix(x).sum(dtype=np.uint64).astype(np.int64))


def allocate(low: int, differ: int, rows: int) -> tuple[int, int]:
    """(segments, spare ones among them that count 2) of a band whose sets have low elements or more: the least expected cost.

    Tried are LEAST_EXTRA to 45 % segments more than differ + 1 (a range of 16 at least) and up to SPARE spare ones. A set can then leave out as many
    empty segments as both numbers say together; sets that have more (a Poisson tail) write those too, and pairs of such
    sets meet in them. Costs are signatures, and pairs at PAIR_COST each.
    """
    best = (math.inf, differ + 1, 0)
    least = differ * LEAST_EXTRA // 100
    for extra in sorted({*range(least, least + 17), *(differ * percent // 100 for percent in range(LEAST_EXTRA, 46))}):
        m = differ + 1 + extra
        mean = low / m
        empty = math.exp(-mean)
        for spare in range(min(SPARE, m - 1) + 1):
            expected = (m - spare) * empty
            term = below = math.exp(-expected)
            for k in range(1, extra + spare + 1):
                term *= expected / k
                below += term
            tail = max(0.0, 1 - below)
            pairs = tail * (expected + extra + spare) * tail * empty * rows / 20  # a twentieth of the rows in a band
            best = min(best, (m + spare * mean + PAIR_COST * pairs, m, spare))
    return best[1:]


def _segments(items: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Hashes that belong to band k alone, the segment of each, and the band's salt: every band deals the universe anew."""
    salt = np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    moved = ta.mix(items + salt)
    return moved, ((moved >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64), salt


def needs(items: np.ndarray, bands: Bands, rows: int) -> list[int]:
    """By parity of the band, how many of its signatures a set shares at least with one that links; 0 where it writes none."""
    need = [0, 0]
    for k in bands.of(len(items)):
        if differ := bands.count(k) - 1:
            m, spare = bands.plan(k, rows)
            free = m - spare - int(np.count_nonzero(np.bincount(_segments(items, k, m)[1], minlength=m)[: m - spare]))
            # of m - differ identical segments at least, all but the empty ones are written
            need[k & 1] = max(1, m - differ - free) if free <= m - 1 - differ + spare else 1
    return need


def signatures(items: np.ndarray, bands: Bands, rows: int) -> np.ndarray:
    """The signatures of a set (sorted hashes).

    A signature's lowest bit is the parity of its band, as a set writes in a band and perhaps in the next one.
    """
    out = []
    for k in bands.of(len(items)):
        differ = bands.count(k) - 1
        if not differ:
            continue  # only equal sets link, and those are one node already
        m, spare = bands.plan(k, rows)
        moved, segment, salt = _segments(items, k, m)
        order = np.argsort(segment, kind="stable")
        total = np.zeros(len(items) + 1, np.uint64)
        weights = ta.mix(moved[order])
        np.cumsum(weights, out=total[1:])
        at = np.searchsorted(segment[order], np.arange(m + 1))
        content = total[at[1:]] - total[at[:-1]]
        size = np.diff(at)
        number = np.arange(m, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + salt + np.uint64(1)
        write = np.ones(m, bool)
        made = []
        if spare:
            last = np.arange(m - spare, m)
            made.extend(ta.mix((content[s] - weights[at[s] : at[s + 1]]) ^ ta.mix(np.full(size[s], number[s]))) for s in last)
        free = np.flatnonzero(size[: m - spare] == 0)
        if len(free) <= m - 1 - differ + spare:
            write[free] = False  # a partner has by this set's counts an equal segment that isn't empty, or a near spare one
        made.append(ta.mix(content ^ ta.mix(number))[write])
        out.append(np.unique(np.concatenate(made)) & ~np.uint64(1) | np.uint64(k & 1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in hash cells, packed to 64-bit words: sets differ in at least as many elements as sketches in bits."""
    bits = max(256, 1 << int(2 * max(len(items), 1) - 1).bit_length())
    cells = np.bincount((ta.mix(items + np.uint64(0xA5A5)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.uint64)


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    while len(s) > words:
        half = len(s) // 2
        s = s[:half] ^ s[half:]
    return s


def _sid() -> F.Column:
    """The row's number within the operator: doc_id, or for a null one a negative hash of the text."""
    return F.coalesce(F.col("doc_id"), -1 - F.abs(F.xxhash64("text") % (1 << 62)))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


NODES = {"doc_id": pa.int64(), "sid": pa.int64(), "tie": pa.int64(), "n": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "need0": pa.int32(), "need1": pa.int32()}


def _nodes(docs: DataFrame, n: int, percent: int, rows: int) -> DataFrame:
    """Of every document doc_id, sid, tie (a hash of the text), n (set size), k1 and k2 (the set's key; null for an empty set), need0 and need1 (see needs())."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()  # what other stages remember in this worker takes room from this one
        bands = Bands(percent)
        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield _batch([(*i, len(items), *(key or (None, None)), *(needs(items, bands, rows) if key else (0, 0))) for i, (items, key) in zip(ids, shingle_sets(batch.column(3), n), strict=True)], NODES)
        give_back()

    return docs.select("doc_id", _sid().alias("sid"), F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, sid long, tie long, n long, k1 long, k2 long, need0 int, need1 int")


def _written(docs: DataFrame, n: int, percent: int, rows: int) -> DataFrame:
    """signature, k1, known and part, a row per signature; a set that comes again in one split writes nothing.

    known: the task wrote the signature for several sets; part: 0, or a salt for all but the first of its rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        bands, seen, out, keys, size = Bands(percent), set(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            signature = np.concatenate(out).astype(np.int64)
            key = np.repeat(np.array(keys, np.int64), [len(x) for x in out])
            order = np.argsort(signature, kind="stable")
            signature, key = signature[order], key[order]
            same = signature[1:] == signature[:-1]
            known, part = np.zeros(len(signature), bool), np.zeros(len(signature), np.int32)
            known[1:], part[1:] = same, np.where(same, 1 + (key[1:] & (SALTS - 1)), 0)
            known[:-1] |= same
            for at in range(0, len(signature), 50_000):
                part_of = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part_of]) for x in (signature, key, known, part)], names=["signature", "k1", "known", "part"])

        for batch in batches:
            for items, key in shingle_sets(batch.column(0), n):
                if key is None or key in seen:
                    continue
                seen.add(key)
                out.append(signatures(items, bands, rows))
                keys.append(key[0])
                size += len(out[-1])
                if size > SORTED:
                    yield from flush()
                    out, keys, size = [], [], 0
        if size:
            yield from flush()
        del out, keys, seen
        give_back()

    return docs.select("text").mapInArrow(run, "signature long, k1 long, known boolean, part int")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, n, items and sketch of the wanted nodes (node, sid, w1, w2), from their texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for node, w1, w2, (items, key) in zip(*(batch.column(k).to_pylist() for k in range(3)), shingle_sets(batch.column(3), n), strict=True):
                if key == (w1, w2):
                    out.append((node, len(items), items.view(np.int64), sketch(items).view(np.int64)))
                    size += len(items)
                if size > 200_000:
                    yield _batch(out, kinds)
                    out, size = [], 0
            yield _batch(out, kinds)
        give_back()

    kinds = {"node": pa.int64(), "n": pa.int64(), "items": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())}
    found = docs.select(_sid().alias("sid"), "text").join(wanted.hint("shuffle_hash"), "sid").select("node", "w1", "w2", "text")
    return found.mapInArrow(run, "node long, n long, items array<long>, sketch array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link: first those whose sketches allow it, then by intersection of the complete sets, row by row in the JVM."""
    small = sets.select("node", "n", "sketch")
    a, b = (small.toDF(x, f"n{x}", f"s{x}") for x in "ab")
    width = F.least(F.size("sa"), F.size("sb"))

    def folded(s: str) -> F.Column:  # linked sizes are so near that sketches differ in width twofold at most
        half = F.transform(F.sequence(F.lit(1), width), lambda k: F.element_at(s, k).bitwiseXOR(F.element_at(s, k + width)))
        return F.when(F.size(s) > width, half).otherwise(F.col(s))

    bits = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.greatest(F.size("sa"), F.size("sb")) <= 2 * width)
    near = pairs.join(a, "a").join(b, "b").where(sizes).where(bits * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
    whole = sets.select("node", "items")
    a, b = (whole.toDF(x, f"i{x}") for x in "ab")
    shared = F.size(F.array_intersect("ia", "ib"))
    return near.join(a, "a").join(b, "b").where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node reachable) of all nodes of edges (a, b)."""
    spark = edges.sparkSession
    edges, _ = store(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, _ = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "hooks")
        for _ in range(2):  # pointer jumping: to the parent's parent
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up, _ = store(up.join(above, "up").select("node", F.col("top").alias("up")), "hooks")
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            labels = labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels, _ = store(labels, "labels")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges, _ = store(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with their component, itself where nothing links."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _forest(keys: np.ndarray, labels: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of pairs (a, b) with distances d, those that connect members not yet connected, the nearest first: fewer than members."""
    up = {int(x): int(x) for x in labels}
    of = dict(zip(keys.tolist(), labels.tolist(), strict=True))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    chosen = []
    for i in np.argsort(d, kind="stable").tolist():
        x, y = top(of[int(a[i])]), top(of[int(b[i])])
        if x != y:
            up[x] = y
            chosen.append(i)
    return np.array(chosen, np.int64)


def _compared(units: DataFrame, sets: DataFrame, percent: int, forest: bool, level: int = 0) -> DataFrame:
    """Pairs of different components in one unit (unit, i, j, own, node, label) whose sketches allow a link; forest: see _forest().

    i and j number the chunks that a unit holds, own the one a row is of; where i and j differ, only pairs across them count.
    level: how many rare shingles the unit stands for; units then has `before`, the row's rare shingles up to the last of these, and
    only pairs that have no other one in common there count: they meet in the unit of their first common ones.
    """
    if not level:
        units = units.withColumn("before", F.array().cast("array<long>"))
    rows = units.join(sets.select("node", "n", "sketch"), "node").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in range(7)]
            sketches = batch.column(7)
            at, words = sketches.offsets.to_numpy(), sketches.values.to_numpy().view(np.uint64)
            unit, i, j = columns[:3]
            ends = [*(np.flatnonzero((unit[1:] != unit[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
            for start, end in zip([0, *ends], ends, strict=False):
                key = (unit[start], i[start], j[start])
                if held and held[0][0] != key:
                    yield from _pairs_of(held, percent, forest, level)
                    held = []
                held.append((key, [c[start:end] for c in columns[3:]], at[start : end + 1], words, batch.column(8)[start:end]))
        if held:
            yield from _pairs_of(held, percent, forest, level)
        del held
        give_back()

    return rows.select("unit", "i", "j", "own", "node", "label", "n", "sketch", "before").mapInArrow(run, "a long, b long").distinct()


def _pairs_of(held: list[tuple], percent: int, forest: bool, level: int) -> Iterator[pa.RecordBatch]:
    """The pairs of one unit; held: runs of its rows as (key, own and node and label and n, offsets of the sketches, words, shingles before)."""
    own, keys, labels, sizes = (np.concatenate(x) for x in zip(*(h[1] for h in held), strict=True))
    if len(keys) < 2:
        return
    widths = np.concatenate([np.diff(at) for _, _, at, _, _ in held])
    width = int(widths.min())
    if (widths == width).all():
        bits = np.concatenate([words[at[0] : at[-1]] for _, _, at, words, _ in held]).reshape(-1, width)
    else:
        bits = np.array([_folded(words[a:b], width) for _, _, at, words, _ in held for a, b in zip(at[:-1], at[1:], strict=True)])
    (_, i, j), every = held[0][0], np.arange(len(keys))
    found = []
    step = max(1, (1 << 18) // (len(keys) * width))
    for at in range(0, len(keys) - 1, step):
        part = slice(at, at + step)
        d = np.bitwise_count(bits[part, None] ^ bits[None, at:]).sum(2, dtype=np.int64)
        total, a, b = sizes[part, None] + sizes[None, at:], sizes[part, None], sizes[None, at:]
        fine = (d * (100 + percent) <= (100 - percent) * total) & (labels[part, None] != labels[None, at:]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (every[None, at:] > every[part, None])
        if i != j:
            fine &= own[part, None] != own[None, at:]
        x, y = np.nonzero(fine)
        found.append((x + at, y + at, d[x, y]))
    x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
    if level and len(x):
        runs = np.cumsum([0, *(len(rows) for *_, rows in held)])

        def shingles(row: int) -> np.ndarray:
            k = int(np.searchsorted(runs, row, "right")) - 1
            return held[k][4][row - int(runs[k])].values.to_numpy()

        first = np.array([len(np.intersect1d(shingles(i), shingles(j), assume_unique=True)) == level for i, j in zip(x.tolist(), y.tolist(), strict=True)])
        x, y, d = x[first], y[first], d[first]
    a, b = keys[x], keys[y]
    if forest and len(a):
        chosen = _forest(keys, labels, a, b, d)
        a, b = a[chosen], b[chosen]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _open(members: DataFrame) -> DataFrame:
    """Of members (unit, node, label) the units that hold several components: unit, size, and largest (a label of most members)."""
    counts = members.groupBy("unit", "label").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("digest"))
    units = counts.groupBy("unit").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("label", "c").alias("largest"), F.count("*").alias("labels"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("digest").alias("digest")).where("labels > 1")
    # units of the same members are one
    return units.groupBy("size", "low", "high", "digest").agg(F.min("unit").alias("unit"), F.min_by("largest", "unit").alias("largest"), F.min_by("most", "unit").alias("most")).select("unit", "size", "most", "largest")


def _dealt(chunks: F.Column, seed: int) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), chunks).cast("int")


def _nearest(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs that would join components inside a chunk of a bucket, the nearest ones."""
    rows = _labelled(members.select(F.col("signature").alias("unit"), "node"), labels)
    rows = rows.join(_open(rows).select("unit", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "unit").withColumn("own", _dealt(F.col("chunks"), seed))
    return _compared(rows.select("unit", F.col("own").alias("i"), F.col("own").alias("j"), "own", "node", "label"), sets, percent, True)


def _all_left(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in a bucket whose sketches allow a link, see the module's text."""
    rows, _ = store(_labelled(members.select(F.col("signature").alias("unit"), "node"), labels), "level")
    rare, made = None, []
    for level in range(LEVELS + 1):
        found, _ = store(_open(rows), "open")
        chunks = F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")
        fine = found.where((F.col("size") <= CHUNK) | (F.col("size") - F.col("most") <= CHUNK))
        large = found.where((F.col("size") > CHUNK) & (F.col("size") - F.col("most") > CHUNK)).select("unit", chunks)
        few = rows.join(fine.select("unit", "size", "largest", chunks), "unit")
        # small units are one chunk; of larger ones each chunk of the largest component meets all that is outside of it
        numbers = F.when(F.col("size") <= CHUNK, F.array(F.lit(0))).when(F.col("label") == F.col("largest"), F.array(_dealt(F.col("chunks"), 0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        more = ["before"] * bool(level)
        few = few.withColumn("i", F.explode(numbers)).select("unit", "i", F.col("i").alias("j"), F.lit(0).alias("own"), "node", "label", *more)
        made.append(_compared(few, sets, percent, False, level))
        if large.isEmpty():
            break
        if level == LEVELS:  # pairs of chunks
            every = rows.join(large, "unit").withColumn("own", _dealt(F.col("chunks"), 0)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            made.append(_compared(every.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", *more), sets, percent, False, level))
            break
        rows, _ = store(rows.join(large.select("unit"), "unit", "left_semi"), "level")
        if rare is None:
            rare, _ = store(_rare(rows.select("node").distinct(), sets, percent), "rare")
            rows = rows.select("node", "label").distinct().withColumns({"unit": F.lit(0).cast("long"), "place": F.lit(0)})
        # the next shared shingle, in ascending order of frequency, among the first of the set
        deeper = rows.join(rare, "node").withColumn("next", F.slice("rare", F.col("place") + 1, F.col("free") + level - F.col("place")))
        deeper = deeper.select("node", "label", "unit", "place", "rare", F.posexplode("next").alias("k", "item")).where("item IS NOT NULL")
        deeper = deeper.withColumn("place", (F.col("place") + F.col("k") + 1).cast("int")).withColumn("before", F.filter(F.slice("rare", F.lit(1), F.col("place")), lambda x: x.isNotNull()))
        rows, _ = store(deeper.select(F.xxhash64("unit", "item").alias("unit"), "node", "label", "place", "before"), "level")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _rare(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, rare (its first shingles in ascending order of frequency among these nodes, null for one that no other has) and free (how many of them tell, at level 1)."""
    own = sets.join(nodes, "node", "left_semi").select("node", "n", F.explode("items").alias("item"))
    seen = own.groupBy("item").agg(F.count("*").alias("df"))
    free = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    ranked = own.join(seen, "item").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("all"))
    return ranked.select("node", F.transform(F.slice("all", F.lit(1), free + LEVELS - 1), lambda x: F.when(x["df"] > 1, x["item"])).alias("rare"), free.alias("free"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b) between nodes."""
    more = _labelled(_labelled(links.withColumnRenamed("a", "node"), labels).select(F.col("label").alias("a"), F.col("b").alias("node")), labels).select("a", F.col("label").alias("b"))
    tops = components(more)
    moved = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    single = tops.join(labels.select("node"), "node", "left_anti")  # nodes that nothing linked before
    return store(moved.union(single.select("node", "label")), "labels")[0]


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", rows: int | None = None, with_tie: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), a row per document.

    rows: the number of rows to plan for; None counts them. with_tie adds tie (xxhash64 of the text, null as empty) and
    component (a number of the component, null for a document without words), which tell rows of one id and components without ids apart.
    """
    spark, since = docs.sparkSession, mark()
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = docs.count() if rows is None else rows
    found, found_path = store(_nodes(docs, n, percent, rows), "shingles")
    filled = found.where("k1 IS NOT NULL")
    # copies inside a split are summed before the shuffle; a class's number lasts as it is written once
    classes = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.min("sid").alias("sid"), F.min("need0").alias("need0"), F.min("need1").alias("need1"))
    classes, classes_path = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    bucket = W.partitionBy("signature", "part")
    ends = [F.min("k1").over(bucket).alias("least"), F.max("k1").over(bucket).alias("greatest"), F.max("known").over(bucket).alias("shared")]
    written = _written(docs, n, percent, rows).select("signature", "k1", *ends).where("shared OR least < greatest").select("signature", "k1")
    # a k1 that two classes have gives both of them, which costs a comparison
    shared, shared_path = store(written.join(classes.select("k1", "node"), "k1").select("signature", "node").distinct(), "shared")
    # nodes that share fewer signatures than a linked one does have no link in that band
    parity = F.col("signature").bitwiseAND(1).alias("parity")
    counted = shared.groupBy("node", parity).agg(F.count("*").alias("c")).join(classes.select("node", "need0", "need1"), "node")
    likely = counted.where("c >= CASE parity WHEN 0 THEN need0 ELSE need1 END").select("node", "parity")
    likely, likely_path = store(shared.withColumn("parity", parity).join(likely, ["node", "parity"], "left_semi").select("signature", "node"), "likely")
    release(spark, since, found_path, classes_path, likely_path)
    least = likely.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("signature", "low")
    members, members_path = store(likely.join(least, "signature"), "buckets")
    star = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    wanted = members.select("node").distinct().join(classes.select("node", "sid", F.col("k1").alias("w1"), F.col("k2").alias("w2")), "node")
    sets, sets_path = store(_sets(docs, wanted, n), "sets")
    labels = components(_verified(star, sets, percent))
    for seed in (1, 2):
        labels = _joined(labels, _verified(_nearest(members, sets, labels, percent, seed), sets, percent))
    labels = _joined(labels, _verified(_all_left(members, sets, labels, percent), sets, percent))
    labelled = _labelled(classes.select("node", "k1", "k2", "low"), labels)
    component = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    of_class, of_class_path = store(labelled.join(component, "label").select("k1", "k2", "component_id", F.col("label").alias("component")), "components")
    release(spark, since, found_path, of_class_path)
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *(["tie", "component"] if with_tie else [])]
    empty = found.where("k1 IS NULL").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return filled.join(of_class, ["k1", "k2"]).select(*columns).unionByName(empty.select(*columns))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


#: All pairs that share a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (na + nb - common)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, t.b FROM r JOIN t ON r.reach = t.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(reach) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""
