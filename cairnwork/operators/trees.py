"""Forests and boosted trees from histograms of binned features.

Features become at most BINS bins by quantiles, rows become blocks of bytes. All trees in hand grow together, a level a pass: tasks add
up histograms of (tree, node), Spark sums them by that key, and where a key's sums meet its best split is chosen; only
those splits reach the driver. A node of at most LOCAL_ROWS rows is finished where its rows are brought together, as small
nodes are in PLANET (Panda et al., 2009): the same sums, the same splits, fewer passes. So no task holds more than that many
rows of a node, and a level's cost is a read of the blocks.

What hangs below such a node is a piece of its tree. A forest's pieces are a table, never on the driver, which holds the tops alone (a node
for some thousands of rows); rows that are to be predicted are sent to the pieces they come to.

Rows are weighted by hash: a forest's bootstrap counts (Poisson of mean 1 by tree and row) and the share of rows a boosting round
sees are the same on any partitioning. Boosting keeps each row's scores beside it, renewed once a round; its lineage is cut by a checkpoint
every CHECKPOINT rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions.batches import matrix
from cairnwork.sources.shipping import ship
from cairnwork.sources.stores import scratch

BINS = 32
LOCAL_ROWS = 4096
BLOCK_ROWS = 4096
CHECKPOINT = 20
#: Trees of a forest that grow in the same passes at most, and bytes of histograms that a task may hold for them.
TOGETHER = 100
MOST_BYTES = 1 << 27
#: Entries of histograms that are looked at together.
CELLS = 1 << 17
#: Rows to be predicted that go together.
ROUTED = 8192
#: One of a forest's shares as an integer: sums of them are the same in any order.
UNIT = 1 << 44
#: Bytes of sums that a task of predictions holds.
HELD = 1 << 26


# ---------------------------------------------------------------- rows


def cut_points(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values at which bins end, approximate quantiles of all rows; a row is in the first bin whose end it doesn't exceed."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.percentile_approx("x", shares, 10_000).alias("q")).collect()  # a row a feature
    return [np.unique(np.array(r["q"], float)) for r in sorted(found, key=lambda r: r["k"])]


def binned(v: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, v[:, k], "left") for k, c in enumerate(cuts)]).astype(np.uint8) if len(v) else np.zeros((0, len(cuts)), np.uint8)


@dataclass
class Block:
    """Rows of one partition: a hash a row, class numbers, binned features, and (boosting) scores."""

    ids: np.ndarray
    classes: np.ndarray
    x: np.ndarray
    scores: np.ndarray | None = None


def _together(part: Iterable[Block]) -> Iterator[Block]:
    """Small blocks of a partition as larger ones."""
    held: list[Block] = []
    for block in chain(part, [None]):
        if held and (block is None or sum(len(b.ids) for b in held) + len(block.ids) > BLOCK_ROWS):
            yield Block(*(np.concatenate([getattr(b, name) for b in held]) for name in ("ids", "classes", "x")))
            held = []
        if block is not None:
            held.append(block)


def blocks(rows: DataFrame, cuts: list[np.ndarray], classes: list[int], key: str | None, n: int) -> RDD:
    """n rows (label, v and key, if there is one) as Blocks; without a key a row's own values are hashed. A partition holds a block's rows at least, where there are as many."""
    ship(rows.sparkSession)
    ident = F.xxhash64(key) if key else F.xxhash64("v", "label")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: k for k, c in enumerate(classes)}
        for batch in batches:
            of = np.array([at[x] for x in batch.column("label").to_pylist()], np.int32)
            ids, x = batch.column("id").to_numpy(), binned(matrix(batch.column("v")), cuts)
            cut = range(0, len(of), BLOCK_ROWS)
            columns = [[a[i : i + BLOCK_ROWS].tobytes() for i in cut] for a in (ids, of, x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["ids", "classes", "x"])

    made = rows.select(ident.alias("id"), F.col("label").cast("int").alias("label"), "v").mapInArrow(run, "ids binary, classes binary, x binary")
    dims = len(cuts)
    found = made.rdd.map(lambda r: Block(np.frombuffer(r.ids, np.int64), np.frombuffer(r.classes, np.int32), np.frombuffer(r.x, np.uint8).reshape(-1, dims)))
    return found.coalesce(max(1, min(found.getNumPartitions(), -(-n // BLOCK_ROWS)))).mapPartitions(_together)


def uniforms(ids: np.ndarray, *salts: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) a row, from its hash and the salts (splitmix64); of an array of salts a row each."""
    x = ids.astype(np.uint64)
    for salt in salts:
        if isinstance(salt, np.ndarray):
            x = x ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))[:, None]
        else:
            x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


#: Shares of Poisson(1) counts up to 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


def bootstrap(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample."""
    return np.searchsorted(POISSON, uniforms(ids, seed, tree + 1), "right").astype(float)


# ---------------------------------------------------------------- growing


#: What rows add up: pairs (column of a row's own, weight); each pair takes as many sums as it has columns.
#: No column: one sum. No weight: 1 a row.
Entry = tuple[np.ndarray | None, int, np.ndarray | None]


@dataclass
class Rule:
    """How trees grow. Sums have their kind as the first axis.

    stats: (block, tree) -> (rows used, entries, whose last sum is 1 a row); score: sums -> a number that splits shall raise in
    total; allowed: (left, right) sums -> whether such a split may be; may: sums -> whether a node with them may split at all;
    features: (tree, nodes) -> those that each node may split on, a row a node or one row for all.
    """

    stats: Callable
    score: Callable[[np.ndarray], np.ndarray]
    allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]
    may: Callable[[np.ndarray], np.ndarray]
    features: Callable[[int, np.ndarray], np.ndarray]
    depth: int
    bins: int = BINS


@dataclass
class Tree:
    """Nodes by number (root 1, below n: 2n and 2n + 1): splits (feature, bin, gain), and sums of all nodes."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row comes to."""
        node = np.ones(len(x), np.int64)
        going = np.arange(len(x))
        while len(going):
            numbers, where = np.unique(node[going], return_inverse=True)
            rule = np.array([self.splits.get(n, (-1, 0))[:2] for n in numbers.tolist()], np.int64)[where]
            more = rule[:, 0] >= 0
            going, rule = going[more], rule[more]
            node[going] = 2 * node[going] + (x[going, rule[:, 0]] > rule[:, 1])
        return node


def taken(entries: list[Entry], rows: np.ndarray) -> list[Entry]:
    """The entries of some rows."""
    return [(c if c is None else c[rows], n, w if w is None else w[rows]) for c, n, w in entries]


def histograms(x: np.ndarray, at: np.ndarray, nodes: int, features: np.ndarray, entries: list[Entry], bins: int) -> np.ndarray:
    """sums x nodes x features x bins, of rows that are in the nodes `at`."""
    out, f = [], features.shape[-1]
    if features.ndim == 1:  # the same for all nodes: feature by feature
        keys = (at * bins + x[:, k] for k in features.tolist())
        found = [[np.bincount(key if c is None else key + c * (nodes * bins), w, n * nodes * bins).reshape(n, nodes, 1, bins) for c, n, w in entries] for key in keys]
        return np.concatenate([np.concatenate(own) for own in found], 2).astype(float, copy=False)
    key = (at[:, None] * f + np.arange(f)) * bins + x[np.arange(len(x))[:, None], features[at]]
    size = nodes * f * bins
    for c, n, w in entries:
        own = key if c is None else key + c[:, None] * size
        out.append(np.bincount(own.ravel(), None if w is None else np.repeat(w, f), n * size).reshape(n, nodes, f, bins))
    return np.concatenate(out).astype(float, copy=False)


def totals(at: np.ndarray, nodes: int, entries: list[Entry]) -> np.ndarray:
    """sums x nodes."""
    return np.concatenate([np.bincount(at if c is None else at + c * nodes, w, n * nodes).reshape(n, nodes) for c, n, w in entries]).astype(float, copy=False)


def best_splits(hist: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A node each: place of the feature (-1: no split gains), bin, gain, left sums, right sums of the greatest gain, ties to the first feature and bin."""
    _, n, _, b = hist.shape
    left = np.cumsum(hist, 3)
    whole = left[..., -1:]
    right = whole - left
    before = rule.score(whole)
    gain = rule.score(left) + rule.score(right) - before
    gain = np.where(rule.allowed(left, right), gain, 0.0)
    scale = np.maximum(1.0, np.abs(before).max((1, 2)))
    rounded = np.round(gain / scale[:, None, None], 10).reshape(n, -1)  # sums in another order change no choice
    i, k = np.arange(n), rounded.argmax(1)
    f, at = np.divmod(k, b)
    return np.where(rounded[i, k] > 0, f, -1), at, gain[i, f, at], left[:, i, f, at], right[:, i, f, at]


def finish(x: np.ndarray, entries: list[Entry], tree: int, root: int, rule: Rule) -> tuple[np.ndarray, ...]:
    """A node and everything below it, from its own rows, a level at a time: nodes in order, the feature each splits on
    (-1: none), bin, gain, where its left child is (the right one is next; -1: none), and sums (sums x nodes)."""
    nodes, at, done, placed = np.array([root], np.int64), np.zeros(len(x), np.int64), [], 1
    sums = totals(at, 1, entries)
    while len(nodes):
        feature, bins, gain = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int32), np.zeros(len(nodes))
        lefts, rights = np.zeros((2, *sums.shape))
        go = np.flatnonzero(rule.may(sums)) if int(nodes[0]).bit_length() <= rule.depth else nodes[:0]
        if len(go):
            features = rule.features(tree, nodes[go])
            place = np.full(len(nodes), -1, np.int64)
            place[go] = np.arange(len(go))
            step = max(1, CELLS // (len(sums) * features.shape[-1] * rule.bins))
            some = place[at]
            if len(go) < len(nodes) or len(go) > step:  # rows in order of their nodes
                rows = np.argsort(some, kind="stable")
                rows = rows[np.searchsorted(some[rows], 0) :]
                x, at, some, entries = _like(x, rows), at[rows], some[rows], taken(entries, rows)
            for first in range(0, len(go), step):
                own, n = go[first : first + step], min(step, len(go) - first)
                rows = slice(*np.searchsorted(some, (first, first + step))) if len(go) > step else slice(None)
                wanted = features if features.ndim == 1 else features[first : first + step]
                f, b, g, left, right = best_splits(histograms(x[rows], some[rows] - first, n, wanted, taken(entries, rows), rule.bins), rule)
                feature[own] = np.where(f < 0, -1, wanted[f] if wanted.ndim == 1 else wanted[np.arange(n), f])
                bins[own], gain[own], lefts[:, own], rights[:, own] = b, g, left, right
        split = np.flatnonzero(feature >= 0)
        child = np.full(len(nodes), -1, np.int32)
        child[split] = placed + 2 * np.arange(len(split))
        done.append((nodes, feature, np.where(feature >= 0, bins, 0), np.where(feature >= 0, gain, 0.0), child, sums))
        placed += 2 * len(split)
        if not len(split):
            break
        place = np.full(len(nodes), -1, np.int64)
        place[split] = np.arange(len(split))
        kept = place[at] >= 0
        if not kept.all():
            rows = np.flatnonzero(kept)
            x, at, entries = _like(x, rows), at[rows], taken(entries, rows)
        at = 2 * place[at] + (x[np.arange(len(x)), feature[at]] > bins[at])
        nodes = (2 * nodes[split][:, None] + np.arange(2)).ravel()
        sums = np.stack([lefts[:, split], rights[:, split]], 2).reshape(len(sums), -1)
    return tuple(np.concatenate(c) for c in list(zip(*done, strict=True))[:5]) + (np.concatenate([d[5] for d in done], 1),)


def _like(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of x, in x's own layout."""
    return x.T[:, rows].T if x.flags.f_contiguous and not x.flags.c_contiguous else x[rows]


def grow_tops(data: RDD, trees: list[int], rule: Rule, rows: int, local_rows: int = LOCAL_ROWS) -> tuple[dict[int, Tree], set[tuple[int, int]]]:
    """Trees by number, all grown together, down to nodes of at most local_rows rows; those nodes. rows: how many data holds."""
    sc = data.context
    parts = max(1, min(data.getNumPartitions(), 4 * sc.defaultParallelism))
    grown = {t: Tree() for t in trees}
    counts = {(t, 1): float(rows) for t in trees}
    small: set[tuple[int, int]] = set()
    while counts:
        small |= {k for k, n in counts.items() if n <= local_rows}
        large = _by_tree(k for k, n in counts.items() if n > local_rows)
        counts = {}
        if not large:
            break
        now = sc.broadcast(grown)

        def level(part: Iterable[Block], wanted=large, now=now) -> Iterator:
            total: dict = {}
            for t, block, used, entries, at in _reached(part, wanted, now.value, rule):
                numbers, at = np.unique(at, return_inverse=True)
                features = rule.features(t, wanted[t][numbers])
                step = max(1, CELLS // (features.shape[-1] * rule.bins))
                for first in range(0, len(numbers), step):
                    own = np.flatnonzero((at >= first) & (at < first + step))
                    n = min(step, len(numbers) - first)
                    h = histograms(block.x[used[own]], at[own] - first, n, features if features.ndim == 1 else features[first : first + step], taken(entries, own), rule.bins)
                    for k in range(n):
                        key = t, int(wanted[t][numbers[first + k]])
                        if key in total:
                            total[key] += h[:, k]
                        else:
                            total[key] = h[:, k].copy()
            yield from total.items()

        def chosen(h: np.ndarray) -> tuple:
            return h[:, 0].sum(1), [c[..., 0] for c in best_splits(h[:, None], rule)]

        found = data.mapPartitions(level).reduceByKey(lambda a, b: a + b, parts).mapValues(chosen).collect()  # a split a node of more than local_rows rows
        for (t, n), (whole, (f, b, gain, left, right)) in found:
            grown[t].sums[n] = whole
            if f < 0:
                continue
            features = rule.features(t, np.array([n]))
            grown[t].splits[n] = (int(features.ravel()[f]), int(b), float(gain))
            grown[t].sums[2 * n], grown[t].sums[2 * n + 1] = left, right
            if n.bit_length() < rule.depth:
                counts |= {(t, 2 * n): left[-1], (t, 2 * n + 1): right[-1]}
        now.unpersist()
    return grown, small


def _by_tree(keys: Iterable[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Their nodes in order, by tree."""
    return {t: np.array([n for _, n in own], np.int64) for t, own in groupby(sorted(keys), lambda k: k[0])}


def _reached(part: Iterable[Block], wanted: dict[int, np.ndarray], grown: dict[int, Tree], rule: Rule) -> Iterator:
    """Tree, block, rows of the block that came to wanted nodes of it, their entries, their nodes' places."""
    for block in part:
        for t, numbers in wanted.items():
            used, entries = rule.stats(block, t)
            node = grown[t].nodes(block.x[used])
            place = np.minimum(np.searchsorted(numbers, node), len(numbers) - 1)
            own = np.flatnonzero(numbers[place] == node)
            if len(own):
                yield t, block, used[own], taken(entries, own), place[own]


def grow_pieces(data: RDD, grown: dict[int, Tree], small: set[tuple[int, int]], rule: Rule) -> RDD:
    """((tree, node), what finish says) of each of the nodes."""
    sc = data.context
    now, wanted = sc.broadcast(grown), _by_tree(small)

    def gather(part: Iterable[Block]) -> Iterator:
        for t, block, used, _, at in _reached(part, wanted, now.value, rule):
            order = np.argsort(at, kind="stable")
            ends = np.flatnonzero(np.diff(at[order])) + 1
            for own in np.split(order, ends):
                rows = used[own]
                yield (t, int(wanted[t][at[own[0]]])), (block.ids[rows], block.classes[rows], block.x[rows], None if block.scores is None else block.scores[rows])

    def below(item: tuple) -> tuple:
        (t, n), found = item
        ids, classes, x, scores = ([f for f in c if f is not None] for c in zip(*found, strict=True))
        block = Block(np.concatenate(ids), np.concatenate(classes), np.concatenate(x), np.concatenate(scores) if scores else None)
        order = np.lexsort((block.classes, block.ids))  # the same sums in whatever order rows come
        block = Block(block.ids[order], block.classes[order], block.x[order], block.scores[order] if scores else None)
        used, entries = rule.stats(block, t)
        return (t, n), finish(block.x[used], entries, t, n, rule)

    return data.mapPartitions(gather).groupByKey(max(1, min(len(small), 4 * sc.defaultParallelism))).map(below)


def grow(data: RDD, trees: list[int], rule: Rule, rows: int, local_rows: int = LOCAL_ROWS) -> dict[int, Tree]:
    """Whole trees by number, for those of bounded depth."""
    grown, small = grow_tops(data, trees, rule, rows, local_rows)
    if small:
        for (t, _), (nodes, feature, bins, gain, _, sums) in grow_pieces(data, grown, small, rule).collect():  # trees: the model
            grown[t].splits |= {n: (f, b, g) for n, f, b, g in zip(nodes.tolist(), feature.tolist(), bins.tolist(), gain.tolist(), strict=True) if f >= 0}
            grown[t].sums |= dict(zip(nodes.tolist(), sums.T, strict=True))
    return grown


# ---------------------------------------------------------------- models


@dataclass
class Packed:
    """A fitted tree as arrays: node numbers in order, the feature a node splits on (-1: none), its bin, its gain, its values."""

    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, tree: Tree, value: Callable[[np.ndarray], np.ndarray], default: np.ndarray, below: set[int] = frozenset()) -> Packed:
        """below: nodes that go on elsewhere."""
        node = np.array(sorted(tree.sums) or [1], np.int64)
        split = [(BELOW, 0, 0.0) if n in below else tree.splits.get(n, (-1, 0, 0.0)) for n in node.tolist()]
        feature, bins, gain = zip(*split, strict=True)
        return cls(node, np.array(feature, np.int32), np.array(bins, np.int32), np.array(gain), np.array([value(tree.sums[n]) if n in tree.sums else default for n in node.tolist()]))

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where the leaf is that each row comes to."""
        at = np.zeros(len(x), np.int64)
        left = np.searchsorted(self.node, 2 * self.node)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            own = at[going]
            at[going] = left[own] + (x[going, self.feature[own]] > self.bin[own])
            going = going[self.feature[at[going]] >= 0]
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        """Of the leaf that each row comes to."""
        return self.value[self.places(x)]

    def plain(self) -> list:
        return [a.tolist() for a in (self.node, self.feature, self.bin, self.gain, self.value)]

    @classmethod
    def back(cls, plain: list) -> Packed:
        return cls(*(np.array(a, k) for a, k in zip(plain, (np.int64, np.int32, np.int32, float, float), strict=True)))


class TreeModel:
    """What trees on the driver share: cuts, classes, packed trees; predictions and parts to be saved."""

    def parts(self) -> tuple[dict, dict]:
        return {}, {"cuts": [c.tolist() for c in self.cuts], "classes": self.classes, "trees": [t.plain() for t in self.trees]}

    def restore(self, parts: dict, values: dict) -> None:
        self.cuts, self.classes = [np.array(c, float) for c in values["cuts"]], values["classes"]
        self.trees = [Packed.back(t) for t in values["trees"]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, truth, proba, pred; the first greatest probability wins."""
        ship(df.sparkSession)
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes = np.array(self.classes)
            for batch in batches:
                if batch.num_rows:
                    p = self.probabilities(binned(matrix(batch.column("v")), self.cuts))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("truth"), pa.array(list(p)), pa.array(classes[p.argmax(1)], pa.int32())], names=[key, "truth", "proba", "pred"])

        return df.select(key, F.col("label").cast("int").alias("truth"), "v").mapInArrow(run, f"`{key}` {kind}, truth int, proba array<double>, pred int")


def _classes(train: DataFrame) -> tuple[list[int], np.ndarray, int]:
    """The class domain in order, rows / (classes * rows of the class), rows."""
    found = sorted((r["label"], r["count"]) for r in train.groupBy(F.col("label").cast("int").alias("label")).count().collect())  # a row a class
    n = sum(c for _, c in found)
    return [c for c, _ in found], np.array([n / (len(found) * c) for _, c in found]), n


#: Pieces of a forest's trees: arrays of node places, as bytes; value: classes' shares of leaves, in order.
PIECES = "tree int, root long, left binary, feature binary, bin binary, gain binary, value binary"
#: The feature of a top's node that goes on in a piece.
BELOW = -2


class Forest:
    """Bootstrapped trees; square root of features a node, min_leaf rows a leaf at least, classes weighted evenly, no pruning.

    The driver holds the trees' tops. pieces (PIECES) is a table in a scratch folder.
    """

    def __init__(self, train: DataFrame, key: str | None = None, trees: int = 500, depth: int = 30, seed: int = 42, min_leaf: int = 2, local_rows: int = LOCAL_ROWS) -> None:
        spark = train.sparkSession
        rows = train.persist()
        self.classes, weights, n = _classes(rows)
        self.cuts = cut_points(rows)
        data = blocks(rows, self.cuts, self.classes, key, n).persist(StorageLevel.MEMORY_AND_DISK)
        k, d = len(self.classes), len(self.cuts)
        some = max(1, int(d**0.5))

        def stats(block: Block, tree: int) -> tuple[np.ndarray, list[Entry]]:
            times = bootstrap(block.ids, tree, seed)
            used = np.flatnonzero(times)
            of = block.classes[used].astype(np.int64)
            return used, [(of, k, times[used] * weights[of]), (None, 1, None)]

        def score(s: np.ndarray) -> np.ndarray:  # rows less their Gini impurity, weighted
            return np.einsum("c...,c...->...", s[:k], s[:k]) / np.maximum(s[:k].sum(0), 1e-300)

        rule = Rule(
            stats, score, lambda a, b: (a[k] >= min_leaf) & (b[k] >= min_leaf), lambda s: (s[k] >= 2 * min_leaf) & ((s[:k] > 0).sum(0) > 1),
            lambda tree, nodes: np.sort(np.argsort(uniforms(np.arange(d), seed + 1, tree, nodes), kind="stable")[:, :some]), depth,
        )
        share = lambda s: s[:k] / max(s[:k].sum(), 1e-300)

        def piece(item: tuple) -> tuple:
            (t, root), (_, feature, bins, gain, left, sums) = item
            leaves = sums[:k, feature < 0]
            value = (leaves / np.maximum(leaves.sum(0), 1e-300)).T
            return t, root, *(bytearray(x.tobytes()) for x in (left.astype(np.int32), feature.astype(np.int32), bins.astype(np.uint8), gain, np.ascontiguousarray(value)))

        folder = scratch(spark, "forest")
        self.tops: list[Packed] = []
        held = some * BINS * (k + 1) * 8 * -(-n // max(1, local_rows))  # bytes of a tree's histograms on a level
        together = max(1, min(TOGETHER, MOST_BYTES // held))
        for at in range(0, trees, together):
            grown, small = grow_tops(data, list(range(at, min(trees, at + together))), rule, n, local_rows)
            made = grow_pieces(data, grown, small, rule).map(piece) if small else data.context.emptyRDD()
            spark.createDataFrame(made, PIECES, verifySchema=False).write.mode("append").parquet(folder)
            below = _by_tree(small)
            self.tops += [Packed.of(grown[t], share, np.full(k, 1 / k), set(below[t].tolist()) if t in below else set()) for t in sorted(grown)]
        self.pieces = spark.read.schema(PIECES).parquet(folder)
        self._importances: np.ndarray | None = None
        data.unpersist()
        rows.unpersist()

    def parts(self) -> tuple[dict, dict]:
        return {}, {"cuts": [c.tolist() for c in self.cuts], "classes": self.classes, "tops": [t.plain() for t in self.tops], "pieces": self.pieces}

    def restore(self, parts: dict, values: dict) -> None:
        self.cuts, self.classes = [np.array(c, float) for c in values["cuts"]], values["classes"]
        self.tops, self.pieces, self._importances = [Packed.back(t) for t in values["tops"]], values["pieces"], None

    def importances(self) -> np.ndarray:
        """Per feature the impurity that its splits take away: shares of each tree's total, averaged over trees that split."""
        if self._importances is None:
            ship(self.pieces.sparkSession)
            d = len(self.cuts)

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for tree, feature, gain in zip(*(batch.column(c) for c in ("tree", "feature", "gain")), strict=True):
                        feature, gain = np.frombuffer(feature.as_buffer(), np.int32), np.frombuffer(gain.as_buffer())
                        total = np.bincount(feature[feature >= 0], gain[feature >= 0], d).astype(float)
                        k = np.flatnonzero(total)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), tree.as_py(), np.int32)), pa.array(k.astype(np.int32)), pa.array(total[k])], names=["tree", "k", "gain"])

            found = self.pieces.select("tree", "feature", "gain").mapInArrow(run, "tree int, k int, gain double")
            found = found.groupBy("tree", "k").agg(F.sum(F.col("gain").cast("decimal(28,12)")).cast("double").alias("gain"))  # decimals: the same in any order
            out = np.zeros((len(self.tops), d))
            for r in found.collect():  # a row a tree and feature
                out[r["tree"], r["k"]] = r["gain"]
            for k, t in enumerate(self.tops):
                split = t.feature >= 0
                np.add.at(out[k], t.feature[split], t.gain[split])
            whole = out.sum(1, keepdims=True)
            shares = out[whole[:, 0] > 0] / whole[whole[:, 0] > 0]
            self._importances = shares.mean(0) if len(shares) else np.zeros(d)
        return self._importances

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, truth, proba, pred; the first greatest probability wins.

        Rows go in blocks, first down the tops; what comes to a piece is sent there, as bytes. A task has one piece at a time, and adds up shares by
        block; a block's sums then meet its keys.
        """
        ship(df.sparkSession)
        kind = df.schema[key].dataType.simpleString()
        d, k, tops, cuts, domain = len(self.cuts), len(self.classes), self.tops, self.cuts, np.array(self.classes)
        names = ["tree", "root", "kind", "block", "size", "at", "x", "keys", "truth"]
        rest = f"block long, size int, at binary, x binary, keys array<{kind}>, truth array<int>"

        def listed(column: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

        def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for whole in batches:
                for first in range(0, whole.num_rows, ROUTED):
                    batch = whole.slice(first, ROUTED)
                    x, n = binned(matrix(batch.column("v")), cuts), batch.num_rows
                    sums = np.zeros((n, k), np.int64)
                    nulls = [pa.nulls(1, pa.list_(batch.column(0).type)), pa.nulls(1, pa.list_(pa.int32()))]
                    for t, top in enumerate(tops):
                        place = top.places(x)
                        below = top.feature[place] == BELOW
                        sums[~below] += fixed_point(top.value[place[~below]])
                        rows = np.flatnonzero(below)
                        rows = rows[np.argsort(place[rows], kind="stable")]
                        for own in np.split(rows, np.flatnonzero(np.diff(place[rows])) + 1) if len(rows) else ():
                            values = [pa.array([v], c) for v, c in ((t, pa.int32()), (int(top.node[place[own[0]]]), pa.int64()), (1, pa.int32()), (number, pa.int64()), (n, pa.int32()), (own.astype(np.int32).tobytes(), pa.binary()), (x[own].tobytes(), pa.binary()))]
                            yield pa.RecordBatch.from_arrays([*values, *nulls], names=names)
                    values = [pa.array([v], c) for v, c in ((-1, pa.int32()), (number, pa.int64()), (0, pa.int32()), (number, pa.int64()), (n, pa.int32()), (None, pa.binary()), (sums.tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*values, listed(batch.column(0)), listed(batch.column("truth"))], names=names)
                    number += 1

        def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks' keys as they come, and sums of shares by block. A piece stands before the rows that come to it."""
            held: dict[int, np.ndarray] = {}
            piece = of = types = None

            def out() -> Iterator[pa.RecordBatch]:
                for number, sums in held.items():
                    values = [pa.array([v], c) for v, c in ((1, pa.int32()), (number, pa.int64()), (len(sums), pa.int32()), (sums.tobytes(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*values, *(pa.nulls(1, c) for c in types)], names=["kind", *rest_names])
                held.clear()

            for batch in batches:
                types = [batch.schema.field(c).type for c in ("keys", "truth")]
                own = {c: batch.column(c).to_pylist() for c in ("tree", "root", "kind", "block", "size")}
                for i, (tree, root, what, number, size) in enumerate(zip(*own.values(), strict=True)):
                    if tree < 0:
                        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(batch.column(c).slice(i, 1) for c in rest_names)], names=["kind", *rest_names])
                        continue
                    if what == 0:
                        left, feature, value = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("left", np.int32), ("feature", np.int32), ("value", float)))
                        leaf = np.cumsum(feature < 0) - 1
                        piece, of = (left.copy(), feature.copy(), np.frombuffer(batch.column("bin")[i].as_buffer(), np.uint8).copy(), fixed_point(value.reshape(-1, k)), leaf), (tree, root)
                        continue
                    x = np.frombuffer(batch.column("x")[i].as_buffer(), np.uint8).reshape(-1, d)
                    at = np.frombuffer(batch.column("at")[i].as_buffer(), np.int32)
                    if number not in held:
                        if sum(s.nbytes for s in held.values()) + size * k * 8 > HELD:
                            yield from out()
                        held[number] = np.zeros((size, k), np.int64)
                    # a tree without any row has no piece
                    held[number][at] += shares_below(piece, x) if of == (tree, root) else fixed_point(np.full(k, 1 / k))
            yield from out()

        def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of a block from its keys and all of its sums, which follow."""
            keys = truth = total = None

            def out() -> pa.RecordBatch:
                p = total / (len(tops) * UNIT)
                pred = domain[np.round(p, 11).argmax(1)].astype(np.int32)
                return pa.RecordBatch.from_arrays([keys, truth, pa.array(list(p), pa.list_(pa.float64())), pa.array(pred)], names=[key, "truth", "proba", "pred"])

            for batch in batches:
                for i, what in enumerate(batch.column("kind").to_pylist()):
                    sums = np.frombuffer(batch.column("x")[i].as_buffer(), np.int64).reshape(-1, k)
                    if what == 0:
                        if total is not None:
                            yield out()
                        keys, truth, total = batch.column("keys")[i].values, batch.column("truth")[i].values, sums.copy()
                    else:
                        total += sums
            if total is not None:
                yield out()

        rest_names = ["block", "size", "x", "keys", "truth"]
        rows = df.select(key, F.col("label").cast("int").alias("truth"), "v").sortWithinPartitions(key)  # the same blocks, should a task run again
        routes = rows.mapInArrow(routed, f"tree int, root long, kind int, {rest}")
        pieces = self.pieces.drop("gain").withColumn("kind", F.lit(0))
        sent = routes.unionByName(pieces, allowMissingColumns=True).repartition("tree", "root").sortWithinPartitions("tree", "root", "kind")
        sums = sent.mapInArrow(added, f"kind int, block long, size int, x binary, keys array<{kind}>, truth array<int>")
        return sums.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(met, f"`{key}` {kind}, truth int, proba array<double>, pred int")


def fixed_point(shares: np.ndarray) -> np.ndarray:
    return np.rint(shares * UNIT).astype(np.int64)


def shares_below(piece: tuple, x: np.ndarray) -> np.ndarray:
    """Fixed-point shares of the leaf of a piece that each row comes to."""
    left, feature, bins, value, leaf = piece
    at = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        own = at[going]
        at[going] = left[own] + (x[going, feature[own]] > bins[own])
        going = going[feature[at[going]] >= 0]
    return value[leaf[at]]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Bytes of rows and scores up to which boosting gives them to each of its tasks.
WHOLE_BYTES = 1 << 25


@dataclass
class Replica:
    """All rows in order, once for each task that grows trees of some classes."""

    number: int
    ids: np.ndarray
    classes: np.ndarray
    x: np.ndarray
    scores: np.ndarray


def replicas(data: RDD, copies: int, k: int) -> RDD:
    """Blocks as so many Replicas of all rows, by a shuffle of bytes."""

    def run(part: Iterable[tuple[int, Block]]) -> Iterator[Replica]:
        held: dict[int, list[Block]] = {}
        for number, block in part:
            held.setdefault(number, []).append(block)
        for number, found in held.items():
            ids, classes, x = (np.concatenate([getattr(b, name) for b in found]) for name in ("ids", "classes", "x"))
            order = np.lexsort((classes, ids))  # the same sums in whatever order rows come
            yield Replica(number, ids[order], classes[order], np.asfortranarray(x[order]), np.zeros((len(ids), k)))

    return data.flatMap(lambda b: [(p, b) for p in range(copies)]).partitionBy(copies, lambda p: p).mapPartitions(run)


class BoostedTrees(TreeModel):
    """Gradient boosting of the softmax: each round one tree a class, on a share of rows and features, second-order leaf values.

    Up to WHOLE_BYTES (or local_rows rows, if that is given) each task has all rows and grows whole trees of its classes: a
    round is one job that sends nothing but trees. Beyond, trees grow a level a pass.
    """

    def __init__(
        self, train: DataFrame, rounds: int = 300, depth: int = 6, seed: int = 42, key: str | None = None, rate: float = 0.1, share: float = 0.8, penalty: float = 1.0, least: float = 1.0, local_rows: int | None = None,
    ) -> None:
        """penalty: added to curvature sums; least: curvature of a leaf at least."""
        rows = train.persist()
        self.classes, weights, n = _classes(rows)
        self.cuts = cut_points(rows)
        k, d = len(self.classes), len(self.cuts)
        some = max(1, int(share * d))
        whole = n * (d + 12 + 8 * k) <= WHOLE_BYTES if local_rows is None else n <= local_rows
        copies = max(1, min(k, rows.sparkSession.sparkContext.defaultParallelism))

        def begun(block: Block) -> Block:
            block.scores = np.zeros((len(block.ids), k))
            return block

        data = blocks(rows, self.cuts, self.classes, key, n)
        data = (replicas(data, copies, k) if whole else data.map(begun)).persist(StorageLevel.MEMORY_AND_DISK)
        _checkpoint_folder(train.sparkSession)
        self.trees, last = [], None
        for number in range(rounds):

            def slopes(block: Block | Replica, tree: int, used: np.ndarray) -> list[Entry]:
                p = softmax(block.scores[used])[:, tree]
                w = weights[block.classes[used]]
                return [(None, 1, w * (p - (block.classes[used] == tree))), (None, 1, w * p * (1 - p))]

            def stats(block: Block, tree: int, number: int = number) -> tuple[np.ndarray, list[Entry]]:
                used = np.flatnonzero(uniforms(block.ids, seed, number + 1) < share)
                return used, [*slopes(block, tree, used), (None, 1, None)]

            rule = Rule(
                stats, lambda s: s[0] ** 2 / (s[1] + penalty), lambda a, b: (a[1] >= least) & (b[1] >= least), lambda s: s[1] >= 2 * least * (1 - 1e-9),
                lambda tree, nodes, number=number: np.sort(np.argsort(uniforms(np.arange(d), seed + 1, number, tree), kind="stable")[:some]), depth,
            )
            leaf = lambda s: -rate * s[0] / (s[1] + penalty)

            def trees_of(replica: Replica, number: int = number, rule: Rule = rule) -> Iterator[tuple[int, Packed]]:
                used = np.flatnonzero(uniforms(replica.ids, seed, number + 1) < share)
                for tree in range(replica.number, k, copies):
                    own = rule.features(tree, np.ones(1, np.int64))
                    x = np.asfortranarray(replica.x[:, own][used])
                    rule_of_own = Rule(rule.stats, rule.score, rule.allowed, rule.may, lambda tree, nodes: np.arange(some), depth)
                    nodes, feature, bins, gain, _, sums = finish(x, slopes(replica, tree, used), tree, 1, rule_of_own)
                    yield tree, Packed(nodes, np.where(feature < 0, -1, own[feature]).astype(np.int32), bins.astype(np.int32), gain, leaf(sums))

            if whole:
                step = [t for _, t in sorted(data.flatMap(trees_of).collect(), key=lambda f: f[0])]  # a tree a class
            else:
                grown = grow(data, list(range(k)), rule, n, LOCAL_ROWS if local_rows is None else local_rows)
                step = [Packed.of(grown[t], leaf, np.float64(0.0)) for t in range(k)]
            if last is not None:
                last.unpersist()  # data has been made from it
            self.trees += step

            def renewed(block: Block | Replica, step: list = step) -> Block | Replica:
                return replace(block, scores=block.scores + np.column_stack([t.values(block.x) for t in step]))

            after = data.map(renewed).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % CHECKPOINT == 0:
                after.checkpoint()
                after.count()
            last, data = data, after
        for done in filter(None, (last, data)):
            done.unpersist()
        rows.unpersist()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        k = len(self.classes)
        scores = np.zeros((len(x), k))
        for at, t in enumerate(self.trees):
            scores[:, at % k] += t.values(x)
        return softmax(scores)


def _checkpoint_folder(spark: SparkSession) -> None:
    """Where lineage is cut: spark.checkpoint.dir; a folder of its own on a local master alone."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch(spark, "checkpoints"))
