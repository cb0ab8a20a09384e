"""Series to frames, and frame features of the waveform.

samples(series_id, t, x) become frames(series_id, frame, x array) by one shuffle on (series_id, chunk of frames); what follows
works on the arrays, a frame's length of numbers each, so that no series has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.sources.shipping import ship

#: More lags than this go through numpy's FFT in Arrow batches instead of an expression each.
LITERAL_LAGS = 32
#: Frames of a series that go together.
CHUNK = 512


def by_frame():
    return W.partitionBy("series_id").orderBy("frame")


def frame_series(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """series_id, frame, i, x: windows that start at 0, hop, ... below n - length; the last full one at n - length is left out."""
    lengths = samples.groupBy("series_id").agg(F.count("*").alias("n"))  # combined before the shuffle; a row a series joins
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (length - 1)) / hop))
    last = F.least(F.floor(F.col("t") / hop), F.ceil((F.col("n") - length) / hop) - 1)
    placed = samples.join(lengths, "series_id").where(F.col("n") > length).withColumn("lo", first).withColumn("hi", last).where("lo <= hi")
    placed = placed.select("series_id", "t", "x", F.explode(F.sequence("lo", "hi")).alias("frame"))
    return placed.select("series_id", F.col("frame").cast("long").alias("frame"), (F.col("t") - F.col("frame") * hop).cast("int").alias("i"), "x")


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups of equal keys, and where groups start. What is held over is the last group of a batch."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            held.append(batch)
        if not held:
            return
        if batch is not None and len(held) > 1 and all(batch.column(k)[-1] == held[0].column(k)[-1] for k in keys):
            continue  # still the same group
        table = pa.Table.from_batches(held).combine_chunks()
        changes = np.zeros(table.num_rows, bool)
        changes[0] = True
        for k in keys:
            column = table.column(k).chunk(0)
            changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(changes)
        end = table.num_rows if batch is None else int(starts[-1])
        held = [] if batch is None else table.slice(end).combine_chunks().to_batches()
        if end:
            yield table.slice(0, end), starts[starts < end]


def frame_arrays(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """series_id, frame, x: the frame's values in order, `length` of them.

    Values go to chunks of CHUNK frames of their series by one shuffle, where they stand in order; frames are cut from them in Arrow batches.
    """
    ship(samples.sparkSession)
    lengths = samples.groupBy("series_id").agg(F.count("*").alias("n"))  # combined before the shuffle; a row a series joins
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (length - 1)) / hop))
    last = F.least(F.floor(F.col("t") / hop), F.ceil((F.col("n") - length) / hop) - 1)
    placed = samples.join(lengths, "series_id").where(F.col("n") > length).withColumn("lo", first).withColumn("hi", last).where("lo <= hi")
    chunk = F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor(F.col("hi") / CHUNK))).alias("chunk")
    placed = placed.select("series_id", F.col("t").cast("long").alias("t"), "x", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), chunk)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["series_id", "chunk"]):
            lo, hi, chunk = (table.column(c).to_numpy() for c in ("lo", "hi", "chunk"))
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(lo)]))
            lo, hi = np.maximum(lo, chunk * CHUNK), np.minimum(hi, chunk * CHUNK + CHUNK - 1)
            times = np.maximum(hi - lo + 1, 0)
            row = np.repeat(np.arange(len(lo)), times)
            frame = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            key = group[row] * CHUNK + (frame - chunk[row] * CHUNK)
            order = np.argsort(key, kind="stable")  # rows of a frame stay in order
            key, row = key[order], row[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            values = table.column("x").chunk(0).take(pa.array(row))
            cut = pa.array(np.r_[begin, len(key)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([table.column("series_id").chunk(0).take(pa.array(row[begin])), pa.array(frame[order][begin]), pa.ListArray.from_arrays(cut, values)], names=["series_id", "frame", "x"])

    kinds = {c: samples.schema[c].dataType.simpleString() for c in ("series_id", "x")}
    dealt = placed.repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "t")
    return dealt.mapInArrow(run, f"series_id {kinds['series_id']}, frame long, x array<{kinds['x']}>")


def rms(x: Column) -> Column:
    return F.sqrt(A.dot(x, x) / F.size(x))


def zcr(x: Column) -> Column:
    """Share of steps at which the sign (0 counts as positive) changes."""
    later = F.slice(x, F.lit(2), F.size(x) - 1)
    changes = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), later, lambda a, b: ((a >= 0) != (b >= 0)).cast("double"))
    return A.total(changes) / F.size(x)


def autocorrelation(x: Column, lags: range) -> Column:
    """Sums of x[t] * x[t + lag], an element a lag."""
    return F.array(*[A.dot(F.slice(x, F.lit(1), F.size(x) - lag), F.slice(x, F.lit(lag + 1), F.size(x) - lag)) for lag in lags])


def autocorrelated(frames: DataFrame, lags: range, literal_lags: int = LITERAL_LAGS) -> DataFrame:
    """series_id, frame, peak (greatest |x|), r0, r: sums of x[t] * x[t + lag], an element a lag.

    Few lags are expressions in the JVM. More of them come from numpy's FFT of frames padded to twice their length, in Arrow batches.
    """
    peak = F.array_max(F.transform("x", F.abs)).alias("peak")
    if len(lags) <= literal_lags:
        return frames.select("series_id", "frame", peak, A.dot(F.col("x"), F.col("x")).alias("r0"), autocorrelation(F.col("x"), lags).alias("r"))
    ship(frames.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(lags)
        for batch in batches:
            x = batch.column("x")
            sizes, flat = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64), x.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            r0, r = np.zeros(len(x)), np.zeros((len(x), len(at)))
            for n in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == n)
                v = flat[(ends[own] - n)[:, None] + np.arange(n)]
                width = 1 << int(2 * n - 1).bit_length()
                found = np.fft.irfft(np.abs(np.fft.rfft(v, width, axis=1)) ** 2, width, axis=1)
                r0[own] = (v * v).sum(1)
                near = at < n
                r[np.ix_(own, near)] = found[:, at[near]]
            # what is left of rounding decides no tie
            r = np.round(r / np.maximum(r0, 1e-300)[:, None], 13) * r0[:, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("series_id", "frame", "peak")], pa.array(r0), pa.array(list(r), pa.list_(pa.float64()))], names=["series_id", "frame", "peak", "r0", "r"])

    kind = frames.schema["series_id"].dataType.simpleString()
    return frames.select("series_id", F.col("frame").cast("long").alias("frame"), peak, "x").mapInArrow(run, f"series_id {kind}, frame long, peak double, r0 double, r array<double>")


def autocorr_peak(frames: DataFrame, length: int) -> DataFrame:
    """series_id, frame, peak: the greatest autocorrelation at lags 1.. over that at lag 0; null for a silent frame."""
    r = autocorrelated(frames, range(1, length))
    return r.select("series_id", "frame", F.when(F.col("r0") != 0, F.array_max("r") / F.col("r0")).alias("peak"))


def mean_step_ratio(track: DataFrame, value: str, out: str) -> DataFrame:
    """series_id, out: mean |step| / mean of the values in order of frame; 0 for fewer than two."""
    steps = track.withColumn("step", F.abs(F.col(value) - F.lag(value).over(by_frame())))
    agg = steps.groupBy("series_id").agg(F.count(value).alias("n"), F.avg("step").alias("s"), F.avg(value).alias("m"))
    return agg.select("series_id", F.when((F.col("n") < 2) | (F.col("m") == 0), 0.0).otherwise(F.col("s") / F.col("m")).alias(out))


def shimmer(frames: DataFrame, f0: DataFrame | None = None) -> DataFrame:
    """Of the frames' peaks above 1e-6; 0 where f0 (series_id, frame, f0) has fewer than two values."""
    peaks = frames.select("series_id", "frame", F.array_max(F.transform("x", F.abs)).alias("peak"))
    found = mean_step_ratio(peaks.where("peak > 1e-6"), "peak", "shimmer")
    found = frames.select("series_id").distinct().join(found, "series_id", "left").fillna(0.0, ["shimmer"])
    if f0 is None:
        return found
    voiced = f0.groupBy("series_id").agg(F.count("f0").alias("v"))
    return found.join(voiced, "series_id", "left").select("series_id", F.when(F.coalesce("v", F.lit(0)) < 2, 0.0).otherwise(F.col("shimmer")).alias("shimmer"))


def jitter(f0: DataFrame) -> DataFrame:
    """Of the periods 1 / max(f0, 1)."""
    return mean_step_ratio(f0.select("series_id", "frame", (1 / F.greatest("f0", F.lit(1.0))).alias("period")), "period", "jitter")


def hnr(frames: DataFrame, length: int) -> DataFrame:
    """series_id, hnr: 10 log10(r / (1 - r)) of the greatest autocorrelation over that at lag 0, mean over frames that aren't silent; 0 if none."""
    scored = autocorrelated(frames, range(1, length)).withColumn("top", F.array_max("r"))
    ratio = F.least(F.greatest(F.col("top") / F.when(F.col("r0") != 0, F.col("r0")), F.lit(1e-10)), F.lit(1 - 1e-10))
    scored = scored.withColumn("db", F.when((F.col("peak") >= 1e-6) & (F.col("r0") >= 1e-10), 10 * F.log10(ratio / (1 - ratio))))
    return scored.groupBy("series_id").agg(F.coalesce(F.avg("db"), F.lit(0.0)).alias("hnr"))


def f0_track(frames: DataFrame, rate: float, low: int, high: int, threshold: float = 0.3) -> DataFrame:
    """series_id, frame, f0 of voiced frames: rate / the lag (low..high) of the greatest normalised autocorrelation, if above threshold."""
    r = autocorrelated(frames, range(low, high + 1))
    voiced = r.where((F.col("r0") > 1e-10) & (F.array_max("r") / F.when(F.col("r0") != 0, F.col("r0")) > threshold))
    return voiced.select("series_id", "frame", (F.lit(rate) / (A.argmax(F.col("r")) + low)).alias("f0"))


def f0_summary(frames: DataFrame, f0: DataFrame) -> DataFrame:
    """series_id, f0_mean, f0_std (population), f0_max, f0_min, f0_range, voiced, f0_slope (per voiced frame); zeros without voiced frames."""
    total = frames.groupBy("series_id").agg(F.count("*").alias("frames"))
    numbered = f0.withColumn("k", (F.row_number().over(by_frame()) - 1).cast("double"))
    s = numbered.groupBy("series_id").agg(F.avg("f0").alias("f0_mean"), F.stddev_pop("f0").alias("f0_std"), F.max("f0").alias("f0_max"), F.min("f0").alias("f0_min"), F.count("*").alias("n"), F.regr_slope("f0", "k").alias("f0_slope"))
    names = ["f0_mean", "f0_std", "f0_max", "f0_min", "f0_slope"]
    full = total.join(s, "series_id", "left").fillna(0, ["n", *names])
    return full.select("series_id", *names[:4], (F.col("f0_max") - F.col("f0_min")).alias("f0_range"), (F.col("n") / F.col("frames")).alias("voiced"), "f0_slope")


def hyperphonation(f0: DataFrame, threshold: float = 1000.0) -> DataFrame:
    """series_id, share of f0 at or above threshold."""
    return f0.groupBy("series_id").agg(F.avg((F.col("f0") >= threshold).cast("double")).alias("hyperphonation"))
