"""Statistical tests per group, from sums: unit root, normality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions.ranks import before
from cairnwork.functions.distributions import normal_cdf, normal_quantile, number, polynomial
from cairnwork.sources.shipping import ship

# MacKinnon's (1994) response surface and (2010) critical values of the unit root test with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (0.038269, 1.4412, 2.1659)
TAU_LARGE = (-0.010368, -0.12745, 0.93202, 1.7339)
CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def tau_p_value(tau: str) -> str:
    """p of a unit root statistic, as an SQL expression."""
    body = f"CASE WHEN {tau} <= {number(TAU_STAR)} THEN {polynomial(tau, TAU_SMALL)} ELSE {polynomial(tau, TAU_LARGE)} END"
    return f"CASE WHEN {tau} > {number(TAU_MAX)} THEN 1.0 WHEN {tau} < {number(TAU_MIN)} THEN 0.0 ELSE {normal_cdf(f'({body})')} END"


def critical_value(level: str, n: str) -> str:
    a, b, c, d = map(number, CRITICAL[level])
    return f"({a} + {b} / {n} + {c} / ({n} * {n}) + {d} / ({n} * {n} * {n}))"


def adf_lag0(samples: DataFrame) -> DataFrame:
    """series_id, adf, p, n_obs, crit_5, stationary: regression of the step on a constant and the last value, from sums."""
    step = samples.withColumn("l", F.lag("x").over(W.partitionBy("series_id").orderBy("t"))).where("l IS NOT NULL").withColumn("d", F.col("x") - F.col("l"))
    s = step.groupBy("series_id").agg(F.count("*").cast("double").alias("n_obs"), F.regr_sxx("d", "l").alias("sxx"), F.regr_syy("d", "l").alias("syy"), F.regr_sxy("d", "l").alias("sxy")).where("n_obs > 3 AND sxx > 0")
    s = s.withColumn("b", F.col("sxy") / F.col("sxx")).withColumn("adf", F.col("b") / F.sqrt((F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n_obs") - 2) / F.col("sxx")))
    s = s.withColumn("p", F.expr(tau_p_value("adf")))
    return s.select("series_id", "adf", "p", F.col("n_obs").cast("long").alias("n_obs"), F.expr(critical_value("5%", "n_obs")).alias("crit_5"), (F.col("p") < 0.05).alias("stationary"))


ADF_SCHEMA = "series_id long, adf double, p double, lags int, n_obs long, stationary boolean, error string"
#: Steps of a series that one chunk covers.
CHUNK_STEPS = 1 << 16


def most_lags(n: Column) -> Column:
    """The greatest number of lagged steps that a series of n values is tried with; negative if it is too short."""
    return F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")


def lag_chunks(samples: DataFrame, steps: int = CHUNK_STEPS) -> DataFrame:
    """series_id, chunk, n, most, first, x: values of `steps` steps and those before that their lags reach, less the series' mean.

    Samples are numbered from 0 without gaps. A value goes to its own chunk and to those after it that reach back to it, so that no
    series has to fit a task.
    """
    facts = samples.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.max("x") == F.min("x")).alias("flat"))
    facts = facts.withColumn("most", most_lags(F.col("n"))).where("most >= 0 AND NOT flat").drop("flat")
    own = F.floor(F.greatest(F.col("t") - 1, F.lit(0)) / steps)  # step t leads to value t
    last = F.least(F.floor((F.col("t") + F.col("most")) / steps), F.floor((F.col("n") - 2) / steps))
    placed = samples.join(facts, "series_id").select("series_id", "n", "most", "t", (F.col("x") - F.col("mean")).alias("x"), F.explode(F.sequence(own, F.greatest(own, last))).alias("chunk"))
    gathered = placed.groupBy("series_id", "chunk").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s"))
    return gathered.select("series_id", "chunk", "n", "most", F.col("s")[0]["t"].alias("first"), F.transform("s", lambda v: v["x"]).alias("x"))


def design(x, first: int, start: int, end: int, most: int):
    """Rows y, x[t - 1], 1 and the lagged steps 1..most of the steps start..end - 1 (step k leads from value k to k + 1); x begins at value `first`."""
    import numpy as np

    d = np.diff(x)
    at = np.arange(start, end) - first
    return np.column_stack([d[at], x[at], np.ones(len(at)), *[np.where(at - k >= 0, d[at - k], 0.0) for k in range(1, most + 1)]])


def cross_products(chunks: DataFrame, steps: int = CHUNK_STEPS) -> DataFrame:
    """series_id, n, most, gram (flat), head: sums over all steps from `most` on, and the values before them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["series_id", "n", "most", "gram", "head"]
        for batch in batches:
            keys, chunk, n, most, first = (batch.column(c).to_pylist() for c in ("series_id", "chunk", "n", "most", "first"))
            grams, heads = [], []
            for k, x in enumerate(batch.column("x")):
                x = x.values.to_numpy()
                z = design(x, first[k], max(most[k], chunk[k] * steps), min(n[k] - 1, (chunk[k] + 1) * steps), most[k])
                grams.append((z.T @ z).ravel())
                heads.append(x[: 2 * most[k] + 2] if chunk[k] * steps <= most[k] else None)
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), pa.array(n, pa.int64()), pa.array(most, pa.int32()), pa.array(grams, pa.list_(pa.float64())), pa.array(heads, pa.list_(pa.float64()))], names=names)

    ship(chunks.sparkSession)
    found = chunks.mapInArrow(run, "series_id long, n long, most int, gram array<double>, head array<double>")
    sums = found.select("series_id", F.posexplode("gram").alias("at", "g")).groupBy("series_id", "at").agg(F.sum("g").alias("g"))
    whole = sums.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "g"))), lambda s: s["g"]).alias("gram"))  # (lags + 3) squared
    heads = found.where("head IS NOT NULL").groupBy("series_id").agg(F.max("n").alias("n"), F.max("most").alias("most"), F.max_by("head", F.size("head")).alias("head"))
    return whole.join(heads, "series_id").select("series_id", "n", "most", "gram", "head")


def choose_lags(gram, head, n: int, most: int):
    """(statistic, lags, steps used) from the cross products of steps from `most` on and the values before them."""
    import numpy as np

    count = n - 1 - most
    # nested regressions: row k of the triangular factor belongs to the k-th regressor, the last row to what is left of y
    order = [*range(1, most + 3), 0]
    lower = np.linalg.cholesky(gram[np.ix_(order, order)] + np.diag([0.0] * (most + 2) + [1e-300]))
    explained = np.cumsum(lower[-1, :-1] ** 2)
    sse = np.maximum(gram[0, 0] - explained[1:], 1e-300)  # with 0, 1, ... lags
    aic = count * np.log(sse / count) + 2 * (np.arange(most + 1) + 2)
    lags = int(aic.argmin())
    kept = [0, 1, 2, *range(3, 3 + lags)]
    whole = gram[np.ix_(kept, kept)]
    if lags < most:  # the steps that fewer lags leave usable
        more = design(head, 0, lags, most, lags)
        whole = whole + more.T @ more
    inverse = np.linalg.inv(whole[1:, 1:])
    beta = inverse @ whole[1:, 0]
    used = n - 1 - lags
    left = whole[0, 0] - beta @ whole[1:, 0]
    return float(beta[0] / np.sqrt(inverse[0, 0] * left / (used - lags - 2))), lags, used


def adf_aic(samples: DataFrame, steps: int = CHUNK_STEPS) -> DataFrame:
    """The unit root test with a constant and the number of lagged steps that has the least AIC, per series.

    Chunks of a series give cross products, Spark sums them, and one small matrix a series gives all nested regressions.
    Series that are constant, too short or collinear become a row with error.
    """

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for n, most, gram, head in zip(batch.column("n").to_pylist(), batch.column("most").to_pylist(), batch.column("gram"), batch.column("head"), strict=True):
                try:
                    adf, lags, used = choose_lags(gram.values.to_numpy().reshape(most + 3, most + 3), head.values.to_numpy(), n, most)
                    out.append((adf, lags, used, None) if np.isfinite(adf) else (None, None, None, "no residuals are left"))
                except np.linalg.LinAlgError as e:
                    out.append((None, None, None, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), *[pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int32(), pa.int64(), pa.string()), strict=True)]], names=["series_id", "adf", "lags", "n_obs", "error"])

    kept = samples.select(F.col("series_id").cast("long").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
    solved = cross_products(lag_chunks(kept, steps), steps).mapInArrow(solve, "series_id long, adf double, lags int, n_obs long, error string")
    every = kept.groupBy("series_id").agg(F.lit("the series is constant or too short").alias("__short"))
    found = every.join(solved.withColumn("__there", F.lit(True)), "series_id", "left").withColumn("error", F.when(F.col("__there"), F.col("error")).otherwise(F.col("__short")))
    p = F.when(F.col("adf").isNotNull(), F.expr(tau_p_value("adf")))
    return found.withColumn("p", p).withColumn("stationary", F.when(F.col("p").isNotNull(), F.col("p") < 0.05)).select("series_id", "adf", "p", "lags", "n_obs", "stationary", "error")


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, n, skew, kurt: population skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


SKEW_Z = {
    "y": "skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))",
    "beta2": "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))",
    "w2": "-1 + sqrt(2 * (beta2 - 1))",
    "ya": "y / sqrt(2 / (w2 - 1))",
    "z1": "ln(ya + sqrt(ya * ya + 1)) / sqrt(ln(w2) / 2)",
}
KURT_Z = {
    "kx": "(kurt + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))",
    "sb": "6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))",
    "ka": "6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb)))",
    "kd": "1 + kx * sqrt(2 / (ka - 4))",
    "z2": "(1 - 2 / (9 * ka) - sign(kd) * power((1 - 2 / ka) / abs(kd), CAST(1 AS DOUBLE) / 3)) / sqrt(2 / (9 * ka))",
}


def dagostino_k2(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, n, skew, kurt, k2, k2_p, k2_normal; null below 20 rows or without spread."""
    m = moments(df, by, x)
    for name, e in {**SKEW_Z, **KURT_Z}.items():
        m = m.withColumn(name, F.when((F.col("n") >= 20) & F.col("skew").isNotNull(), F.expr(e)))
    k2 = F.col("z1") * F.col("z1") + F.col("z2") * F.col("z2")
    return m.withColumn("k2", k2).withColumn("k2_p", F.exp(-F.col("k2") / 2)).select(*by, F.col("n").cast("long").alias("n"), "skew", "kurt", "k2", "k2_p", (F.col("k2_p") >= 0.05).alias("k2_normal"))


#: Ranks of one value that are added up at a time.
BLOCK_RANKS = 4096


def shapiro_francia(df: DataFrame, by: list[str], x: str, block: int = BLOCK_RANKS) -> DataFrame:
    """by, w, w_p, w_normal: squared correlation of the sorted values with normal scores; Royston's (1993) p.

    Values collapse to counts, ranks come by ranges of values, and a value's copies are a block of ranks whose scores are added
    up in parts of at most `block`, dealt to tasks by their place: no task holds a group or the copies of a value. p is meant for up to 5000 rows a group.
    """
    rows = df.where(F.col(x).isNotNull()).select(*by, x)
    facts = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.avg(x).alias("__mean"))
    counted = rows.groupBy(*by, x).agg(F.count("*").alias("__c"))
    ranked = before(counted, by, x, "__below", F.col("__c"))
    below, last = F.col("__below"), F.col("__below") + F.col("__c")
    ranks = F.transform(F.sequence(F.lit(0), F.floor((F.col("__c") - 1) / block)), lambda k: F.struct((below + k * block + 1).alias("lo"), F.least(last, below + (k + 1) * block).alias("hi")))
    parts = ranked.select(*by, x, F.explode(ranks).alias("__r"))
    parts = parts.repartition(*by, x, "__r.lo").join(facts, by) if by else parts.repartition(x, "__r.lo").crossJoin(F.broadcast(facts))  # a row
    scores = F.expr(f"transform(transform(sequence(__r.lo, __r.hi), i -> (i - 0.375D) / (__n + 0.25D)), q -> {normal_quantile('q')})")
    scored = parts.withColumn("__m", scores).select(
        *by, "__n", (F.col(x) - F.col("__mean")).alias("__d"), (F.col("__r.hi") - F.col("__r.lo") + 1).alias("__k"), F.aggregate("__m", F.lit(0.0), lambda a, v: a + v).alias("__s"), F.aggregate("__m", F.lit(0.0), lambda a, v: a + v * v).alias("__ss"),
    )
    k, d, s = F.col("__k"), F.col("__d"), F.col("__s")
    sums = scored.groupBy(*by).agg(F.max("__n").cast("double").alias("n"), F.sum(k * d * d).alias("__dd"), F.sum(k * d).alias("__ds"), F.sum(d * s).alias("__dm"), F.sum(s).alias("__m"), F.sum("__ss").alias("__mm"))
    covariance = F.col("__dm") - F.col("__ds") * F.col("__m") / F.col("n")
    spread = (F.col("__dd") - F.col("__ds") * F.col("__ds") / F.col("n")) * (F.col("__mm") - F.col("__m") * F.col("__m") / F.col("n"))
    w = sums.withColumn("w", covariance * covariance / F.when(spread > 0, spread))
    u = "ln(n)"
    z = f"((ln(1 - w) - (-1.2725 + 1.0521 * (ln({u}) - {u}))) / (1.0308 - 0.26758 * (ln({u}) + 2 / {u})))"
    w = w.withColumn("z", F.expr(z)).withColumn("w_p", F.expr(f"1 - {normal_cdf('z')}"))
    return w.select(*by, "w", "w_p", (F.col("w_p") >= 0.05).alias("w_normal"))


def normality_table(long: DataFrame, label: str = "label", first: int = 10, least: int = 8) -> DataFrame:
    """label, k and both tests of the first features; classes below `least` rows are left out."""
    cut = long.where(F.col("k") < first)
    both = dagostino_k2(cut, [label, "k"], "x").where(F.col("n") >= least)
    return both.join(shapiro_francia(cut, [label, "k"], "x"), [label, "k"])


def pass_rate(results: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Share of true among those that aren't null."""
    return results.groupBy(*by).agg(F.avg(F.col(flag).cast("int")).alias("pass_rate"))


def pivot_pvalues(results: DataFrame, feature: str, label: str, labels: list, p: str) -> DataFrame:
    """A row a feature, a column a class of the domain; the mean where there are several."""
    wide = results.groupBy(feature).pivot(label, labels).agg(F.avg(p))
    return wide.select(feature, *[F.col(f"`{x}`").alias(f"p_{x}") for x in labels])
