"""Queries of frames, spectra and pooled vectors, on series of events with frames of 16 values and hops of 8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.operators import clips
from cairnwork.operators import frames as fr
from cairnwork.operators import spectral as sp
from cairnwork.operators import transforms
from cairnwork.plans.base import CENTRED, centred, query
from cairnwork.plans.splitting import U32

N, HOP, RATE, BANDS, CEPS, LOW = 16, 8, 16.0, 6, 4, 1.0
LAGS = (2, 8)

FRAMES = CENTRED + f""",
lens AS (SELECT series_id, count(*) AS n FROM centred GROUP BY 1),
starts AS (SELECT series_id, unnest(range(0, n - {N}, {HOP})) // {HOP} AS frame FROM lens WHERE n > {N}),
frames AS (SELECT s.series_id, s.frame, (c.t - s.frame * {HOP})::INT AS i, c.x FROM starts s JOIN centred c ON c.series_id = s.series_id AND c.t >= s.frame * {HOP} AND c.t < s.frame * {HOP} + {N})"""


def frames(spark, d) -> DataFrame:
    return fr.frame_arrays(centred(spark, d), N, HOP)


def rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    """The columns rounded; + 0.0 makes minus zero zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def spread(df: DataFrame, column: str, names: tuple[str, str], digits: int = 5) -> DataFrame:
    """An array column as rows, rounded."""
    keys = [c for c in df.columns if c != column]
    return rounded(df.select(*keys, F.posexplode(column).alias(*names)), names[1], digits=digits)


def r(x: str, digits: int = 5) -> str:
    return f"round({x}, {digits}) + 0.0"


@query("frame_series", f"WITH {FRAMES} SELECT * FROM frames")
def frame_series(spark, d):
    return fr.frame_series(centred(spark, d), N, HOP)


@query("frame_rms", f"WITH {FRAMES}, f AS (SELECT series_id, frame, sqrt(avg(x * x)) AS v FROM frames GROUP BY ALL) SELECT series_id, frame, {r('v')} AS rms, {r('avg(v) OVER (PARTITION BY series_id)')} AS series_rms FROM f")
def frame_rms(spark, d):
    f = frames(spark, d).select("series_id", "frame", fr.rms(F.col("x")).alias("rms"))
    return rounded(f.withColumn("series_rms", F.avg("rms").over(W.partitionBy("series_id"))), "rms", "series_rms")


@query("frame_zcr", f"WITH {FRAMES}, l AS (SELECT *, lag(x) OVER (PARTITION BY series_id, frame ORDER BY i) AS p FROM frames) SELECT series_id, frame, {r(f'count(*) FILTER ((x >= 0) <> (p >= 0)) / {N}')} AS zcr FROM l GROUP BY ALL")
def frame_zcr(spark, d):
    return rounded(frames(spark, d).select("series_id", "frame", fr.zcr(F.col("x")).alias("zcr")), "zcr")


@query("shimmer", f"WITH {FRAMES}, p AS (SELECT series_id, frame, max(abs(x)) AS peak FROM frames GROUP BY ALL), l AS (SELECT *, abs(peak - lag(peak) OVER (PARTITION BY series_id ORDER BY frame)) AS step FROM p WHERE peak > 1e-6) SELECT series_id, {r('CASE WHEN count(*) < 2 THEN 0 ELSE avg(step) / avg(peak) END')} AS shimmer FROM l GROUP BY ALL")
def shimmer(spark, d):
    return rounded(fr.shimmer(frames(spark, d)), "shimmer")


AUTO = FRAMES + """,
auto AS (SELECT a.series_id, a.frame, (b.i - a.i)::INT AS lag, sum(a.x * b.x) AS r FROM frames a JOIN frames b ON a.series_id = b.series_id AND a.frame = b.frame AND b.i >= a.i GROUP BY ALL),
zero AS (SELECT series_id, frame, r AS r0 FROM auto WHERE lag = 0)"""
TRACK = AUTO + f""",
best AS (SELECT series_id, frame, max(r) AS top, arg_min(lag, -r) AS lag FROM (SELECT * FROM auto WHERE lag BETWEEN {LAGS[0]} AND {LAGS[1]} ORDER BY lag) GROUP BY ALL),
track AS (SELECT series_id, frame, {RATE}::DOUBLE / lag AS f0 FROM best JOIN zero USING (series_id, frame) WHERE r0 > 1e-10 AND top / r0 > 0.3)"""


@query("autocorr_peak", f"WITH {AUTO} SELECT series_id, frame, {r('max(r) / any_value(r0)')} AS peak FROM auto JOIN zero USING (series_id, frame) WHERE lag > 0 GROUP BY ALL")
def autocorr_peak(spark, d):
    return rounded(fr.autocorr_peak(frames(spark, d), N), "peak")


@query("hnr", f"WITH {AUTO}, p AS (SELECT series_id, frame, least(greatest(max(r) / any_value(r0), 1e-10), 1 - 1e-10) AS q FROM auto JOIN zero USING (series_id, frame) WHERE lag > 0 GROUP BY ALL) SELECT series_id, {r('avg(10 * log10(q / (1 - q)))')} AS hnr FROM p GROUP BY ALL")
def hnr(spark, d):
    return rounded(fr.hnr(frames(spark, d), N), "hnr")


def track(spark, d) -> DataFrame:
    return fr.f0_track(frames(spark, d), RATE, *LAGS)


@query("f0_track", f"WITH {TRACK} SELECT series_id, frame, {r('f0')} AS f0 FROM track")
def f0_track(spark, d):
    return rounded(track(spark, d), "f0")


@query("f0_summary", f"""WITH {TRACK}, n AS (SELECT series_id, count(DISTINCT frame) AS frames FROM frames GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY frame) - 1 AS k FROM track),
s AS (SELECT series_id, avg(f0) AS m, stddev_pop(f0) AS s, max(f0) AS hi, min(f0) AS lo, count(*) AS n, coalesce(regr_slope(f0, k), 0) AS sl FROM k GROUP BY ALL)
SELECT series_id, {r('coalesce(m, 0)')} AS f0_mean, {r('coalesce(s, 0)')} AS f0_std, {r('coalesce(hi, 0)')} AS f0_max, {r('coalesce(lo, 0)')} AS f0_min, {r('coalesce(hi - lo, 0)')} AS f0_range, {r('coalesce(s.n, 0) / frames')} AS voiced, {r("coalesce(CASE WHEN isnan(sl) THEN 0 ELSE sl END, 0)")} AS f0_slope FROM n LEFT JOIN s USING (series_id)""")
def f0_summary(spark, d):
    f = frames(spark, d)
    return rounded(fr.f0_summary(f, fr.f0_track(f, RATE, *LAGS)), "f0_mean", "f0_std", "f0_max", "f0_min", "f0_range", "voiced", "f0_slope")


@query("jitter", f"WITH {TRACK}, p AS (SELECT series_id, frame, 1 / greatest(f0, 1) AS p FROM track), l AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY series_id ORDER BY frame)) AS step FROM p) SELECT series_id, {r('CASE WHEN count(*) < 2 THEN 0 ELSE avg(step) / avg(p) END')} AS jitter FROM l GROUP BY ALL")
def jitter(spark, d):
    return rounded(fr.jitter(track(spark, d)), "jitter")


@query("hyperphonation", f"WITH {TRACK} SELECT series_id, {r('avg((f0 >= 4)::INT)')} AS hyperphonation FROM track GROUP BY ALL")
def hyperphonation(spark, d):
    return rounded(fr.hyperphonation(track(spark, d), 4.0), "hyperphonation")


SPECTRUM = FRAMES + f""",
basis AS (SELECT k::INT AS bin, i::INT AS i, (0.5 - 0.5 * cos(2 * pi() * i / {N})) * cos(2 * pi() * k * i / {N}) AS c, (0.5 - 0.5 * cos(2 * pi() * i / {N})) * sin(2 * pi() * k * i / {N}) AS s FROM range({N // 2 + 1}) a(k), range({N}) b(i)),
spec AS (SELECT series_id, frame, bin, power(sum(x * c), 2) + power(sum(x * s), 2) AS p, bin * {RATE}::DOUBLE / {N} AS f FROM frames JOIN basis USING (i) GROUP BY ALL)"""


def spectra(spark, d) -> DataFrame:
    return sp.power_spectrum(frames(spark, d), N)


@query("power_spectrum", f"WITH {SPECTRUM} SELECT series_id, frame, bin, {r('p', 3)} AS p FROM spec")
def power_spectrum(spark, d):
    return spread(spectra(spark, d), "p", ("bin", "p"), 3)


BANK = sp.mel_filterbank(BANDS, N, RATE)
VALUES = ", ".join(f"({b}, {k}, {w!r}::DOUBLE)" for b, row in enumerate(BANK) for k, w in enumerate(row))
MEL = SPECTRUM + f", bank(band, bin, w) AS (VALUES {VALUES}), mel AS (SELECT series_id, frame, band, sum(p * w) AS e FROM spec JOIN bank USING (bin) GROUP BY ALL)"
DB = MEL + ", db AS (SELECT series_id, frame, band, greatest(10 * log10(greatest(e, 1e-10) / greatest(max(e) OVER (PARTITION BY series_id), 1e-10)), -80) AS db FROM mel)"
CEP = DB + f", cep AS (SELECT series_id, frame, j::INT AS k, sum(db * sqrt(CASE WHEN j = 0 THEN 1 ELSE 2 END / {BANDS}) * cos(pi() * j * (2 * band + 1) / (2 * {BANDS}))) AS c FROM db, range({CEPS}) q(j) GROUP BY ALL)"


def bands_db(spark, d) -> DataFrame:
    return sp.to_db(sp.mel_bands(spectra(spark, d), BANK))


def cepstra(spark, d) -> DataFrame:
    return sp.cepstrum(bands_db(spark, d), BANDS, CEPS)


@query("mel_bands", f"WITH {MEL} SELECT series_id, frame, band, {r('e', 3)} AS e FROM mel")
def mel_bands(spark, d):
    return spread(sp.mel_bands(spectra(spark, d), BANK), "bands", ("band", "e"), 3)


@query("to_db", f"WITH {DB} SELECT series_id, frame, band, {r('db')} AS db FROM db")
def to_db(spark, d):
    return spread(bands_db(spark, d), "db", ("band", "db"))


@query("cepstrum", f"WITH {CEP} SELECT series_id, frame, k, {r('c', 4)} AS c FROM cep")
def cepstrum(spark, d):
    return spread(cepstra(spark, d), "c", ("k", "c"), 4)


LOGMAP = sp.log_band_map(N, RATE, LOW)
USED = sorted({b for b in LOGMAP if b is not None})
LOGVALUES = ", ".join(f"({USED.index(b)}, {k})" for k, b in enumerate(LOGMAP) if b is not None)


@query("log_freq_cepstrum", f"""WITH {SPECTRUM}, lb(band, bin) AS (VALUES {LOGVALUES}), e AS (SELECT series_id, frame, band, sum(p) AS e FROM spec JOIN lb USING (bin) GROUP BY ALL),
ldb AS (SELECT series_id, frame, band, greatest(10 * log10(greatest(e, 1e-10) / greatest(max(e) OVER (PARTITION BY series_id), 1e-10)), -80) AS db FROM e)
SELECT series_id, frame, j::INT AS k, {r(f'sum(db * sqrt(CASE WHEN j = 0 THEN 1 ELSE 2 END / {len(USED)}) * cos(pi() * j * (2 * band + 1) / (2 * {len(USED)})))', 4)} AS c FROM ldb, range({min(20, len(USED))}) q(j) GROUP BY ALL""")
def log_freq_cepstrum(spark, d):
    return spread(sp.log_freq_cepstrum(spectra(spark, d), N, RATE, LOW), "c", ("k", "c"), 4)


def delta_sql(order: int) -> str:
    tap = "o / 60.0::DOUBLE" if order == 1 else "2 * (o * o - 60 / 9.0::DOUBLE) / 308"
    return f"""WITH {CEP}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, k ORDER BY frame) - 1 AS at, count(*) OVER (PARTITION BY series_id, k) AS n FROM cep),
t AS (SELECT a.series_id, a.frame, a.k, a.n, sum(b.c * ({tap})) AS d FROM n a, range(-4, 5) q(o) JOIN n b ON b.series_id = a.series_id AND b.k = a.k AND b.at = least(greatest(a.at, 4), a.n - 5) + o WHERE a.n >= 9 GROUP BY ALL)
SELECT series_id, frame, k, {r('d', 4)} AS d FROM t"""


@query("delta", delta_sql(1).replace("FROM t", "FROM t UNION ALL SELECT series_id, frame, k, 0 FROM n WHERE n < 9"))
def delta(spark, d):
    return spread(sp.delta(cepstra(spark, d), 1), "d", ("k", "d"), 4)


@query("delta_delta", delta_sql(2).replace("FROM t", "FROM t UNION ALL SELECT series_id, frame, k, 0 FROM n WHERE n < 9"))
def delta_delta(spark, d):
    return spread(sp.delta(cepstra(spark, d), 2), "d", ("k", "d"), 4)


DESC = SPECTRUM + """,
cen AS (SELECT series_id, frame, sum(f * sqrt(p)) / sum(sqrt(p)) AS centroid, sum(sqrt(p)) AS whole, exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS flatness FROM spec GROUP BY ALL),
bw AS (SELECT series_id, frame, sqrt(sum(sqrt(p) * (f - centroid) * (f - centroid)) / any_value(whole)) AS bandwidth FROM spec JOIN cen USING (series_id, frame) GROUP BY ALL),
cum AS (SELECT series_id, frame, f, sum(sqrt(p)) OVER (PARTITION BY series_id, frame ORDER BY bin) AS c FROM spec),
ro AS (SELECT series_id, frame, min(f) AS rolloff FROM cum JOIN cen USING (series_id, frame) WHERE c >= 0.85 * whole GROUP BY ALL)"""


def described(spark, d) -> DataFrame:
    return sp.descriptors(spectra(spark, d), N, RATE)


for _name, _table in (("centroid", "cen"), ("bandwidth", "bw"), ("rolloff", "ro"), ("flatness", "cen")):
    query(f"spectral_{_name}", f"WITH {DESC} SELECT series_id, frame, {r(_name)} AS {_name} FROM {_table}")(lambda spark, d, c=_name: rounded(described(spark, d).select("series_id", "frame", c), c))

OCTAVES = sp.octave_bands(N, RATE, 2.0)


@query("spectral_contrast", f"WITH {SPECTRUM}, o(band, lo, hi) AS (VALUES {', '.join(f'({b}, {lo}, {hi})' for b, (lo, hi) in enumerate(OCTAVES))}) SELECT series_id, frame, band, {r('10 * log10(greatest(max(sqrt(p)), 1e-10) / greatest(min(sqrt(p)), 1e-10))', 3)} AS contrast FROM spec JOIN o ON bin >= lo AND bin < hi GROUP BY ALL")
def spectral_contrast(spark, d):
    return spread(sp.contrast(spectra(spark, d), N, RATE, 2.0), "contrast", ("band", "contrast"), 3)


CLASSES = sp.pitch_classes(N, RATE, 1.0)


@query("chroma", f"WITH {SPECTRUM}, m(bin, class) AS (VALUES {', '.join(f'({k}, {c})' for k, c in enumerate(CLASSES) if c is not None)}), g AS (SELECT series_id, frame, q.c::INT AS class, coalesce(sum(p) FILTER (m.class = q.c), 0) AS e FROM spec LEFT JOIN m USING (bin), range(12) q(c) GROUP BY ALL) SELECT series_id, frame, class, {r('e / max(e) OVER (PARTITION BY series_id, frame)')} AS v FROM g")
def chroma(spark, d):
    return spread(sp.chroma(spectra(spark, d), N, RATE, 1.0), "chroma", ("class", "v"))


@query("pool_six", f"""WITH {CEP}, m AS (SELECT series_id, k, avg(c) AS m, count(*) AS n, stddev_pop(c) AS s, min(c) AS lo, max(c) AS hi FROM cep GROUP BY ALL)
SELECT series_id, k, {r('any_value(m)', 4)} AS mean, {r('any_value(s)', 4)} AS std, {r('any_value(lo)', 4)} AS min, {r('any_value(hi)', 4)} AS max, {r('CASE WHEN any_value(s) = 0 THEN 0 ELSE avg(power(c - m, 3)) / power(any_value(s), 3) END', 3)} AS skew, {r('CASE WHEN any_value(s) = 0 THEN 0 ELSE avg(power(c - m, 4)) / power(any_value(s), 4) - 3 END', 3)} AS kurtosis FROM cep JOIN m USING (series_id, k) GROUP BY ALL""")
def pool_six(spark, d):
    return rounded(rounded(sp.pool_six(cepstra(spark, d), "c"), "mean", "std", "min", "max", digits=4), "skew", "kurtosis", digits=3)


@query("pool_two", f"WITH {CEP} SELECT series_id, k, {r('avg(c)', 4)} AS mean, {r('stddev_pop(c)', 4)} AS std FROM cep GROUP BY ALL")
def pool_two(spark, d):
    return rounded(sp.pool_two(cepstra(spark, d), "c"), "mean", "std", digits=4)


def descriptor_means(f: DataFrame) -> DataFrame:
    """Series means of ZCR, centroid, rolloff, bandwidth, RMS, flatness; both tables have the frame's key and partitioning."""
    wave = f.select("series_id", "frame", fr.zcr(F.col("x")).alias("zcr"), fr.rms(F.col("x")).alias("rms"))
    both = wave.join(sp.descriptors(sp.power_spectrum(f, N), N, RATE), ["series_id", "frame"])
    return both.groupBy("series_id").agg(*[F.avg(c).alias(c) for c in ("zcr", "centroid", "rolloff", "bandwidth", "rms", "flatness")])


@query("descriptor_block", f"""WITH {DESC}, w AS (SELECT series_id, frame, count(*) FILTER ((x >= 0) <> (p >= 0)) / {N} AS zcr, sqrt(avg(x * x)) AS rms FROM (SELECT *, lag(x) OVER (PARTITION BY series_id, frame ORDER BY i) AS p FROM frames) GROUP BY ALL)
SELECT series_id, {r('avg(zcr)')} AS zcr, {r('avg(centroid)')} AS centroid, {r('avg(rolloff)')} AS rolloff, {r('avg(bandwidth)')} AS bandwidth, {r('avg(rms)')} AS rms, {r('avg(flatness)')} AS flatness FROM w JOIN cen USING (series_id, frame) JOIN bw USING (series_id, frame) JOIN ro USING (series_id, frame) GROUP BY ALL""")
def descriptor_block(spark, d):
    return rounded(descriptor_means(frames(spark, d)), "zcr", "centroid", "rolloff", "bandwidth", "rms", "flatness")


def joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "series_id"), parts)


# ---------------------------------------------------------------- whole vectors: blocks in order, a row a value

LOGS = min(20, len(USED))


def delta_ctes(source: str, out: str, order: int) -> str:
    """CTE `out` (series_id, frame, k, c): the derivative of source; zeros for series of fewer than nine frames."""
    tap = "o / 60.0::DOUBLE" if order == 1 else "2 * (o * o - 60 / 9.0::DOUBLE) / 308"
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY series_id, k ORDER BY frame) - 1 AS at, count(*) OVER (PARTITION BY series_id, k) AS n FROM {source}),
{out} AS (SELECT a.series_id, a.frame, a.k, sum(b.c * ({tap})) AS c FROM {out}_n a, range(-4, 5) q(o) JOIN {out}_n b ON b.series_id = a.series_id AND b.k = a.k AND b.at = least(greatest(a.at, 4), a.n - 5) + o WHERE a.n >= 9 GROUP BY ALL
UNION ALL SELECT series_id, frame, k, 0 FROM {out}_n WHERE n < 9)"""


LOGCEP = f"""lb(band, bin) AS (VALUES {LOGVALUES}), le AS (SELECT series_id, frame, band, sum(p) AS e FROM spec JOIN lb USING (bin) GROUP BY ALL),
ldb AS (SELECT series_id, frame, band, greatest(10 * log10(greatest(e, 1e-10) / greatest(max(e) OVER (PARTITION BY series_id), 1e-10)), -80) AS db FROM le),
lcep AS (SELECT series_id, frame, j::INT AS k, sum(db * sqrt(CASE WHEN j = 0 THEN 1 ELSE 2 END / {len(USED)}) * cos(pi() * j * (2 * band + 1) / (2 * {len(USED)}))) AS c FROM ldb, range({LOGS}) q(j) GROUP BY ALL)"""
CONTRAST = f"ob(band, lo, hi) AS (VALUES {', '.join(f'({b}, {lo}, {hi})' for b, (lo, hi) in enumerate(OCTAVES))}), con AS (SELECT series_id, frame, band AS k, 10 * log10(greatest(max(sqrt(p)), 1e-10) / greatest(min(sqrt(p)), 1e-10)) AS c FROM spec JOIN ob ON bin >= lo AND bin < hi GROUP BY ALL)"
CHROMA = f"""pm(bin, class) AS (VALUES {', '.join(f'({k}, {c})' for k, c in enumerate(CLASSES) if c is not None)}), cg AS (SELECT series_id, frame, q.c::INT AS class, coalesce(sum(p) FILTER (pm.class = q.c), 0) AS e FROM spec LEFT JOIN pm USING (bin), range(12) q(c) GROUP BY ALL),
chr AS (SELECT series_id, frame, class AS k, e / max(e) OVER (PARTITION BY series_id, frame) AS c FROM cg)"""
WAVE = f"wave AS (SELECT series_id, frame, count(*) FILTER ((x >= 0) <> (p >= 0)) / {N} AS zcr, sqrt(avg(x * x)) AS rms FROM (SELECT *, lag(x) OVER (PARTITION BY series_id, frame ORDER BY i) AS p FROM frames) GROUP BY ALL)"
ONLY = lambda whole, start: whole[len(start) :].lstrip(", \n")  # noqa: E731 - CTEs behind those of start
PITCH = ONLY(TRACK, FRAMES) + """,
fn AS (SELECT series_id, count(DISTINCT frame) AS frames FROM frames GROUP BY ALL), fk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY frame) - 1 AS k FROM track),
fs AS (SELECT series_id, avg(f0) AS m, stddev_pop(f0) AS s, max(f0) AS hi, min(f0) AS lo, count(*) AS n, coalesce(regr_slope(f0, k), 0) AS sl FROM fk GROUP BY ALL),
pitch AS (SELECT series_id, coalesce(m, 0) AS f0_mean, coalesce(s, 0) AS f0_std, coalesce(hi, 0) AS f0_max, coalesce(lo, 0) AS f0_min, coalesce(hi - lo, 0) AS f0_range, coalesce(fs.n, 0) / frames AS voiced, coalesce(CASE WHEN isnan(sl) THEN 0 ELSE sl END, 0) AS f0_slope FROM fn LEFT JOIN fs USING (series_id))"""
PITCHES = ["f0_mean", "f0_std", "f0_max", "f0_min", "f0_range", "voiced", "f0_slope"]
MEANS = ["zcr", "centroid", "rolloff", "bandwidth", "rms", "flatness"]
FIVE = ["zcr", "centroid", "bandwidth", "rolloff", "rms"]
SIX = ["mean", "std", "min", "max", "skew", "kurtosis"]
TWO = ["mean", "std"]
CEPSTRA = {"mfcc": ("cep", CEPS), "mfcc_d": ("d1", CEPS), "mfcc_dd": ("d2", CEPS), "cqcc": ("lcep", LOGS), "cqcc_d": ("l1", LOGS), "cqcc_dd": ("l2", LOGS)}
POOLED = {**CEPSTRA, "contrast": ("con", len(OCTAVES)), "chroma": ("chr", 12)}
NAMES_411 = [f"{b}_{k}_{s}" for b in CEPSTRA for s in TWO for k in range(CEPSTRA[b][1])] + PITCHES + [f"{b}_{k}_{s}" for b in ("contrast", "chroma") for s in TWO for k in range(POOLED[b][1])] + MEANS
NAMES_750 = [f"{b}_{k}_{s}" for b in ("mfcc", "mfcc_d", "mfcc_dd") for k in range(CEPS) for s in SIX] + [f"{c}_{s}" for c in FIVE for s in SIX]
NAMES_32 = ["f0_mean", "f0_std", "f0_range", "hyperphonation", "hnr", "jitter", "shimmer"] + [f"mfcc_{k}" for k in range(CEPS)] + [f"mfcc_d_{k}" for k in range(CEPS)]


def two_sql(block: str) -> str:
    table = POOLED[block][0]
    return f"SELECT series_id, '{block}_' || k || '_mean' AS name, avg(c) AS v FROM {table} GROUP BY ALL UNION ALL SELECT series_id, '{block}_' || k || '_std', stddev_pop(c) FROM {table} GROUP BY ALL"


def six_sql(prefix: str, table: str) -> str:
    """`table` (series_id, k, c); prefix: an expression of k."""
    stats = {"mean": "m", "std": "s", "min": "lo", "max": "hi", "skew": "CASE WHEN s = 0 THEN 0 ELSE a3 / power(s, 3) END", "kurtosis": "CASE WHEN s = 0 THEN 0 ELSE a4 / power(s, 4) - 3 END"}
    inner = f"(SELECT t.series_id, t.k, any_value(m) AS m, any_value(s) AS s, any_value(lo) AS lo, any_value(hi) AS hi, avg(power(c - m, 3)) AS a3, avg(power(c - m, 4)) AS a4 FROM {table} t JOIN (SELECT series_id, k, avg(c) AS m, stddev_pop(c) AS s, min(c) AS lo, max(c) AS hi FROM {table} GROUP BY ALL) q ON q.series_id = t.series_id AND q.k = t.k GROUP BY t.series_id, t.k)"
    return " UNION ALL ".join(f"SELECT series_id, {prefix} || '_{name}' AS name, {e} AS v FROM {inner}" for name, e in stats.items())


def vector_sql(ctes: list[str], values: list[str], names: list[str], digits: int) -> str:
    return f"WITH {', '.join(ctes)}, vals AS ({' UNION ALL '.join(values)}), pl AS (SELECT unnest(range({len(names)}))::INT AS place, unnest({names}) AS name) SELECT series_id, place, name, {r('v', digits)} AS value FROM vals JOIN pl USING (name)"


def laid_out(vectors: DataFrame, names: list[str], digits: int) -> DataFrame:
    """series_id, place, name, value of each entry of vector."""
    long = vectors.select("series_id", F.posexplode("vector").alias("place", "value"))
    return rounded(long.withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("place"))), "value", digits=digits).select("series_id", "place", "name", "value")


def settled(vector: Column) -> Column:
    """Values without the last bits, which follow the order of rows: halfway values round away from zero whatever the order."""
    return F.transform(vector, lambda v: F.round(v, 9))


DELTAS = [delta_ctes("cep", "d1", 1), delta_ctes("cep", "d2", 2)]
DESCRIBED = f"{WAVE}, de AS (SELECT * FROM wave JOIN cen USING (series_id, frame) JOIN bw USING (series_id, frame) JOIN ro USING (series_id, frame))"


@query("clip_vector_411", vector_sql(
    [CEP, *DELTAS, LOGCEP, delta_ctes("lcep", "l1", 1), delta_ctes("lcep", "l2", 2), PITCH, CONTRAST, CHROMA, ONLY(DESC, SPECTRUM), DESCRIBED],
    [*[two_sql(b) for b in POOLED], *[f"SELECT series_id, '{n}', {n} FROM pitch" for n in PITCHES], *[f"SELECT series_id, '{n}', avg({n}) FROM de GROUP BY ALL" for n in MEANS]], NAMES_411, 4))
def clip_vector_411(spark, d):
    """The blocks in order: cepstrum with deltas (mean, std each), log-frequency cepstrum likewise, pitch, contrast, chroma, descriptors."""
    return laid_out(clips.vectors(frames(spark, d), clips.Settings(N, RATE, BANK, CEPS, LOW, 2.0, 1.0, LAGS)), NAMES_411, 4)


@query("clip_vector_750", vector_sql(
    [CEP, *DELTAS, ONLY(DESC, SPECTRUM), DESCRIBED, "five AS (" + " UNION ALL ".join(f"SELECT series_id, '{c}' AS k, {c} AS c FROM de" for c in FIVE) + ")"],
    [*[six_sql(f"'{b}_' || k", CEPSTRA[b][0]) for b in ("mfcc", "mfcc_d", "mfcc_dd")], six_sql("k", "five")], NAMES_750, 3))
def clip_vector_750(spark, d):
    """Cepstrum and both deltas with six statistics each, then five descriptors with six."""
    f = frames(spark, d)
    s = sp.power_spectrum(f, N)
    c = sp.cepstrum(sp.to_db(sp.mel_bands(s, BANK)), BANDS, CEPS)
    wave = f.select("series_id", "frame", fr.zcr(F.col("x")).alias("zcr"), fr.rms(F.col("x")).alias("rms"))
    five = wave.join(sp.descriptors(s, N, RATE), ["series_id", "frame"]).select("series_id", "frame", F.array(*FIVE).alias("c"))
    parts = {"mfcc": c, "mfcc_d": sp.delta(c, 1).withColumnRenamed("d", "c"), "mfcc_dd": sp.delta(c, 2).withColumnRenamed("d", "c"), "descriptors": five}
    whole = joined([sp.vector(sp.pool_six(x, "c"), SIX, name, stat_major=False) for name, x in parts.items()])
    return laid_out(whole.select("series_id", settled(F.concat(*parts)).alias("vector")), NAMES_750, 3)


def step_ratio(table: str, value: str, least: str) -> str:
    return f"SELECT series_id, CASE WHEN count(*) < 2 OR avg({value}) = 0 THEN 0 ELSE avg(step) / avg({value}) END AS v FROM (SELECT *, abs({value} - lag({value}) OVER (PARTITION BY series_id ORDER BY frame)) AS step FROM {table} WHERE {least}) GROUP BY ALL"


DOMAIN = f"""per AS (SELECT series_id, frame, 1 / greatest(f0, 1) AS p FROM track), jit AS ({step_ratio('per', 'p', 'true')}), hyp AS (SELECT series_id, avg((f0 >= 4)::INT) AS v FROM track GROUP BY ALL),
pk AS (SELECT series_id, frame, max(abs(x)) AS p FROM frames GROUP BY ALL), shi AS ({step_ratio('pk', 'p', 'p > 1e-6')}), vo AS (SELECT series_id, count(*) AS n FROM track GROUP BY ALL),
hq AS (SELECT series_id, frame, least(greatest(max(r) / any_value(r0), 1e-10), 1 - 1e-10) AS q FROM auto JOIN zero USING (series_id, frame) WHERE lag > 0 AND r0 >= 1e-10 GROUP BY ALL), har AS (SELECT series_id, avg(10 * log10(q / (1 - q))) AS v FROM hq GROUP BY ALL),
dom AS (SELECT p.*, coalesce(hyp.v, 0) AS hyperphonation, coalesce(har.v, 0) AS hnr, coalesce(jit.v, 0) AS jitter, CASE WHEN coalesce(vo.n, 0) < 2 THEN 0 ELSE coalesce(shi.v, 0) END AS shimmer
FROM pitch p LEFT JOIN hyp USING (series_id) LEFT JOIN har USING (series_id) LEFT JOIN jit USING (series_id) LEFT JOIN shi USING (series_id) LEFT JOIN vo USING (series_id))"""


@query("domain_vector_32", vector_sql(
    [CEP, DELTAS[0], PITCH, DOMAIN],
    [*[f"SELECT series_id, '{n}' AS name, {n} AS v FROM dom" for n in NAMES_32[:7]], "SELECT series_id, 'mfcc_' || k, avg(c) FROM cep GROUP BY ALL", "SELECT series_id, 'mfcc_d_' || k, avg(c) FROM d1 GROUP BY ALL"], NAMES_32, 4))
def domain_vector_32(spark, d):
    """f0 mean, std, range; hyperphonation; HNR; jitter; shimmer; means of the cepstrum and its first delta."""
    f = frames(spark, d)
    f0 = fr.f0_track(f, RATE, *LAGS)
    s = sp.cepstrum(sp.to_db(sp.mel_bands(sp.power_spectrum(f, N), BANK)), BANDS, CEPS)
    means = sp.vector(sp.pool_two(s, "c"), ["mean"], "cepstrum")
    deltas = sp.vector(sp.pool_two(sp.delta(s, 1), "d"), ["mean"], "deltas")
    whole = fr.f0_summary(f, f0).select("series_id", "f0_mean", "f0_std", "f0_range")
    for part in (fr.hyperphonation(f0, 4.0), fr.hnr(f, N), fr.jitter(f0), fr.shimmer(f, f0)):
        whole = whole.join(part, "series_id", "left")
    scalars = [F.coalesce(c, F.lit(0.0)) for c in ("f0_mean", "f0_std", "f0_range", "hyperphonation", "hnr", "jitter", "shimmer")]
    return laid_out(joined([whole, means, deltas]).select("series_id", F.concat(F.array(*scalars), "cepstrum", "deltas").alias("vector")), NAMES_32, 4)


def mask_sql() -> str:
    out = []
    for axis, size in (("band", BANDS), ("frame", 8)):
        for m in range(2):
            width = f"floor({U32.format(f"'42{axis}w{m}|' || series_id")} * 3)"
            start = f"floor({U32.format(f"'42{axis}s{m}|' || series_id")} * greatest({size} - {width}, 1))"
            out.append(f"({axis} >= {start} AND {axis} < {start} + {width})")
    return " OR ".join(out)


@query("spec_mask", f"WITH {DB} SELECT series_id, frame, band, {r(f'CASE WHEN {mask_sql()} THEN 0 ELSE db END')} AS db FROM db")
def spec_mask(spark, d):
    return rounded(transforms.spec_mask(bands_db(spark, d).select("series_id", "frame", F.posexplode("db").alias("band", "db")), BANDS, 8, 2, 2), "db")


@query("band_normalize", f"WITH {DB}, t AS (SELECT band, avg(db) AS m, stddev_pop(db) AS s FROM db WHERE series_id % 5 <> 0 GROUP BY band) SELECT series_id, frame, band, {r('(db - m) / (s + 1e-8)', 4)} AS z FROM db JOIN t USING (band)")
def band_normalize(spark, d):
    from cairnwork.operators import scaling

    long = bands_db(spark, d).select("series_id", "frame", F.posexplode("db").alias("band", "db"))
    return rounded(scaling.band_normalize(long, F.col("series_id") % 5 != 0), "z", digits=4)


@query("attention_pool", f"WITH {CENTRED}, w AS (SELECT series_id, t, x, exp(x / 100 - max(x / 100) OVER (PARTITION BY series_id)) AS e FROM centred), a AS (SELECT *, e / sum(e) OVER (PARTITION BY series_id) AS a FROM w) SELECT series_id, {r('sum(a * x)', 4)} AS pooled, {r('max(a)', 6)} AS top_weight FROM a GROUP BY ALL")
def attention_pool(spark, d):
    from cairnwork.operators import scaling

    weights = scaling.attention_weights(centred(spark, d), F.col("x") / 100)
    pooled = weights.groupBy("series_id").agg(F.sum(F.col("weight") * F.col("x")).alias("pooled"), F.max("weight").alias("top_weight"))
    return rounded(rounded(pooled, "pooled", digits=4), "top_weight", digits=6)
