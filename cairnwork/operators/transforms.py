"""Series transforms: Column -> Column registry, and those that need neighbours or other tables.

Series are long tables (series_id, t, x); windows go by series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.hashing import uniform

#: Values of a series that one window covers.
CHUNK_VALUES = 1 << 16


def by_time():
    """Windows within the chunks of in_chunks()."""
    return W.partitionBy("series_id", "__chunk").orderBy("t")


def in_chunks(samples: DataFrame, back: int, ahead: int, apply: Callable[[DataFrame], DataFrame], size: int = CHUNK_VALUES) -> DataFrame:
    """apply() to chunks of each series that also hold the `back` values before and the `ahead` values behind them.

    So that windows by_time() see the neighbours that they need, and no series has to fit a task. t counts from 0 without gaps.
    """
    first, last = F.floor(F.greatest(F.col("t") - ahead, F.lit(0)) / size), F.floor((F.col("t") + back) / size)
    placed = samples.withColumn("__chunk", F.explode(F.sequence(first, last)))
    return apply(placed).where(F.floor(F.col("t") / size) == F.col("__chunk")).drop("__chunk")


def normal(seed: int | str, *columns: str) -> Column:
    """A standard normal number by Box and Muller from two hashed uniforms."""
    u, v = uniform(f"{seed}a", *columns), uniform(f"{seed}b", *columns)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def add_noise(x: Column, amplitude: float | Column, seed: int = 42) -> Column:
    return x + (F.lit(amplitude) if isinstance(amplitude, (int, float)) else amplitude) * normal(seed, "series_id", "t")


def add_noise_snr(samples: DataFrame, snr_db: float, seed: int = 42) -> DataFrame:
    """samples with y = x + noise scaled to the signal's power less snr_db, per series; powers are aggregates that join, a row a series."""
    noisy = samples.withColumn("noise", normal(seed, "series_id", "t"))
    powers = noisy.groupBy("series_id").agg(F.avg(F.col("x") * F.col("x")).alias("__power"), F.avg(F.col("noise") * F.col("noise")).alias("__own"))
    scaled = F.col("noise") * F.sqrt(F.col("__power") / (F.col("__own") * 10 ** (snr_db / 10)))
    return noisy.join(powers, "series_id").select(*samples.columns, (F.col("x") + scaled).alias("y"))


def time_shift(x: Column, k: int) -> Column:
    """k > 0 delays, k < 0 advances; 0 comes in. Inside in_chunks() with a reach of |k|; shifted() does both."""
    return F.lag(x, k, 0.0).over(by_time()) if k >= 0 else F.lead(x, -k, 0.0).over(by_time())


def shifted(samples: DataFrame, outs: dict[str, int], size: int = CHUNK_VALUES) -> DataFrame:
    """samples with a column for each shift of x."""
    reach = [*outs.values(), 0]
    return in_chunks(samples, max(reach), max(0, -min(reach)), lambda s: s.withColumns({name: time_shift(F.col("x"), k) for name, k in outs.items()}), size)


def random_gain(x: Column, low: float = -6.0, high: float = 6.0, seed: int = 42) -> Column:
    """One gain in dB a series."""
    return x * F.pow(F.lit(10.0), (low + (high - low) * uniform(seed, "series_id")) / 20)


def fixed_gain(x: Column, db: float) -> Column:
    return x * 10 ** (db / 20)


def fir_convolve(samples: DataFrame, impulse: list[float], wet: float, size: int = CHUNK_VALUES) -> DataFrame:
    """series_id, t, x = (1 - wet) * x + wet * (x * h), cut to the series' length. The impulse is a literal: taps become lags."""
    out = F.lit(0.0)
    for k, h in enumerate(impulse):
        out = out + h * F.lag("x", k, 0.0).over(by_time())
    return in_chunks(samples, len(impulse) - 1, 0, lambda s: s.withColumn("x", (1 - wet) * F.col("x") + wet * out), size)


#: Transforms of one value by name; plans and ablations name them.
REGISTRY: dict[str, Callable[[Column], Column]] = {
    "gain_up": lambda x: fixed_gain(x, 6.0),
    "gain_down": lambda x: fixed_gain(x, -6.0),
    "flip": lambda x: -x,
    "shift_right": lambda x: time_shift(x, 4),
    "shift_left": lambda x: time_shift(x, -4),
    "noise_low": lambda x: add_noise(x, 0.003),
    "noise_high": lambda x: add_noise(x, 0.005),
}
#: How many values before and behind a transform looks at, where it does.
REACH: dict[str, tuple[int, int]] = {"shift_right": (4, 0), "shift_left": (0, 4)}


def register(name: str, transform: Callable[[Column], Column], back: int = 0, ahead: int = 0) -> None:
    """back, ahead: the values before and behind that a transform with windows by_time() looks at."""
    REGISTRY[name] = transform
    REACH[name] = (back, ahead)


def compose(samples: DataFrame, names: list[str], size: int = CHUNK_VALUES) -> DataFrame:
    """x after the named transforms, in order. Each is a step of its own, as windows can't nest."""
    for name in names:
        step = lambda s, name=name: s.withColumn("x", REGISTRY[name](F.col("x")))
        reach = REACH.get(name, (0, 0))
        samples = in_chunks(samples, *reach, step, size) if any(reach) else step(samples)
    return samples


def spec_mask(bands: DataFrame, n_bands: int, n_frames: int, band_width: int = 10, frame_width: int = 20, masks: int = 2, seed: int = 42) -> DataFrame:
    """bands (series_id, frame, band, db) with 0 inside masks: `masks` of bands, `masks` of frames, places and widths by hash.

    The masks are functions of the series' hash, so that the anti-join of ranges is a plain condition.
    """
    masked = F.lit(False)
    for axis, size, most in (("band", n_bands, band_width), ("frame", n_frames, frame_width)):
        for m in range(masks):
            width = F.floor(uniform(f"{seed}{axis}w{m}", "series_id") * (most + 1))
            start = F.floor(uniform(f"{seed}{axis}s{m}", "series_id") * F.greatest(size - width, F.lit(1)))
            masked = masked | ((F.col(axis) >= start) & (F.col(axis) < start + width))
    return bands.withColumn("db", F.when(masked, 0.0).otherwise(F.col("db")))
