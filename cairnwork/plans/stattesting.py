"""Queries of statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwork.functions.distributions import normal_cdf, normal_quantile
from cairnwork.operators import stattests as st
from cairnwork.plans.base import LONG, SAMPLES, long_features, query, samples

LAG0 = f"""{SAMPLES}, st AS (SELECT series_id, x, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS l FROM samples),
sums AS (SELECT series_id, count(*)::DOUBLE AS n_obs, regr_sxx(x - l, l) AS sxx, regr_syy(x - l, l) AS syy, regr_sxy(x - l, l) AS sxy FROM st WHERE l IS NOT NULL GROUP BY 1),
a AS (SELECT *, (sxy / sxx) / sqrt((syy - sxy / sxx * sxy) / (n_obs - 2) / sxx) AS adf FROM sums WHERE n_obs > 3 AND sxx > 0),
adf AS (SELECT *, {st.tau_p_value('adf')} AS p, {st.critical_value('5%', 'n_obs')} AS crit_5 FROM a)"""


def adf(spark, d):
    return st.adf_lag0(samples(spark, d))


@query("adf_test", f"WITH {LAG0} SELECT series_id, round(adf, 5) AS adf, round(p, 5) AS p, n_obs::BIGINT AS n_obs, round(crit_5, 5) AS crit_5, p < 0.05 AS stationary FROM adf")
def adf_test(spark, d):
    return adf(spark, d).withColumns({c: F.round(c, 5) for c in ("adf", "p", "crit_5")})


#: Lagged steps that the SQL of the test with lags writes out: enough for series of 180 values.
SQL_LAGS = 14


def residuals(name: str, source: str, columns: list[str], last: list[str]) -> str:
    """CTEs {name}_0, ...: one column after the other is taken out of those behind it and out of `last`, per series."""
    text, at = [], source
    for k, c in enumerate(columns):
        rest = [*columns[k + 1 :], *last]
        taken = ", ".join(f"{r} - coalesce(sum({r} * {c}) OVER w / nullif(sum({c} * {c}) OVER w, 0), 0) * {c} AS {r}" for r in rest)
        text.append(f"{name}_{k} AS (SELECT series_id, n, most, p, {', '.join([*columns[:k], c])}, {taken} FROM {at} WINDOW w AS (PARTITION BY series_id))")
        at = f"{name}_{k}"
    return ", ".join(text)


LAG_COLUMNS = [f"g{j}" for j in range(1, SQL_LAGS + 1)]
LAGGED = ", ".join(f"CASE WHEN {j} <= {{0}} THEN lag(d, {j}) OVER w ELSE 0 END AS g{j}" for j in range(1, SQL_LAGS + 1))
AIC_SQL = f"""WITH {SAMPLES}, ln AS (SELECT series_id, count(*) AS n, least(ceil(12 * power(count(*) / 100, 0.25)), floor(count(*) / 2) - 2)::INT AS most, max(x) = min(x) AS flat FROM samples GROUP BY 1),
st AS (SELECT series_id, n, most, t - 1 AS k, x - lag(x) OVER w AS d, lag(x) OVER w AS l, 1.0::DOUBLE AS o FROM samples JOIN ln USING (series_id) WHERE most >= 0 AND NOT flat WINDOW w AS (PARTITION BY series_id ORDER BY t)),
a0 AS (SELECT *, NULL::INT AS p, {LAGGED.format('most')} FROM st WHERE d IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY k)),
a1 AS (SELECT * FROM a0 WHERE k >= most), {residuals('ra', 'a1', ['l', 'o', *LAG_COLUMNS], ['d'])},
aic AS ({' UNION ALL '.join(f"SELECT series_id, any_value(most) AS most, {j} AS p, count(*) * ln(sum(d * d) / count(*)) + 2 * {j + 2} AS aic FROM ra_{j + 1} GROUP BY series_id HAVING any_value(most) >= {j}" for j in range(SQL_LAGS + 1))}),
best AS (SELECT series_id, p FROM aic QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, p) = 1),
b0 AS (SELECT st.*, best.p, {LAGGED.format('p')} FROM st JOIN best USING (series_id) WHERE d IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY k)),
b1 AS (SELECT * FROM b0 WHERE k >= p), {residuals('rb', 'b1', ['o', *LAG_COLUMNS, 'l'], ['d'])},
bs AS (SELECT series_id, any_value(p) AS lags, count(*) AS n_obs, sum(l * l) AS ll FROM rb_{SQL_LAGS + 1} GROUP BY 1),
bb AS (SELECT series_id, sum(d * l) AS dl FROM rb_{SQL_LAGS} GROUP BY 1), be AS (SELECT series_id, sum(d * d) AS sse FROM rb_{SQL_LAGS + 1} GROUP BY 1),
adf AS (SELECT series_id, lags, n_obs, (dl / ll) / sqrt(sse / (n_obs - lags - 2) / ll) AS adf FROM bs JOIN bb USING (series_id) JOIN be USING (series_id)),
pv AS (SELECT *, {st.tau_p_value('adf')} AS p FROM adf)
SELECT series_id, round(adf, 4) AS adf, round(p, 4) AS p, lags, n_obs, p < 0.05 AS stationary, CASE WHEN adf IS NULL THEN 'the series is constant or too short' END AS error FROM ln LEFT JOIN pv USING (series_id)"""


@query("adf_test_aic", AIC_SQL)
def adf_test_aic(spark, d):
    """Lags by AIC, from cross products of chunks of each series."""
    return st.adf_aic(samples(spark, d)).withColumns({c: F.round(c, 4) for c in ("adf", "p")})


def steps(parts: dict, source: str) -> tuple[str, str]:
    """CTEs that add one expression each; the last one's name."""
    text, at = [], source
    for name, e in parts.items():
        text.append(f"s_{name} AS (SELECT *, {e} AS {name} FROM {at})")
        at = f"s_{name}"
    return ", ".join(text), at


K_STEPS, K_LAST = steps({**st.SKEW_Z, **st.KURT_Z}, "mom20")
K2 = f"""{LONG}, ten AS (SELECT * FROM long WHERE k < 10),
m0 AS (SELECT label, k, avg(x) AS m, stddev_pop(x) AS s, count(*)::DOUBLE AS n FROM ten GROUP BY ALL),
mom AS (SELECT label, k, any_value(n) AS n, avg(power(x - m, 3)) / power(any_value(s), 3) AS skew, avg(power(x - m, 4)) / power(any_value(s), 4) - 3 AS kurt FROM ten JOIN m0 USING (label, k) GROUP BY ALL),
mom20 AS (SELECT * FROM mom WHERE n >= 20), {K_STEPS},
k2 AS (SELECT label, k, n::BIGINT AS n, skew, kurt, z1 * z1 + z2 * z2 AS k2, exp(-(z1 * z1 + z2 * z2) / 2) AS k2_p FROM {K_LAST} UNION ALL SELECT label, k, n::BIGINT, skew, kurt, NULL, NULL FROM mom WHERE n < 20)"""
W = f"""{LONG}, ten AS (SELECT * FROM long WHERE k < 10),
rk AS (SELECT label, k, x, (row_number() OVER (PARTITION BY label, k ORDER BY x) - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY label, k) + 0.25::DOUBLE) AS q, count(*) OVER (PARTITION BY label, k)::DOUBLE AS n FROM ten),
sc AS (SELECT *, {normal_quantile('q')} AS m FROM rk), w0 AS (SELECT label, k, max(n) AS n, power(corr(x, m), 2) AS w FROM sc GROUP BY ALL),
w1 AS (SELECT *, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS z FROM w0), wt AS (SELECT label, k, w, 1 - {normal_cdf('z')} AS w_p FROM w1)"""


def ten(spark, d):
    return long_features(spark, d).where("k < 10")


@query("dagostino_k2", f"WITH {K2} SELECT label, k, n, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(k2, 5) AS k2, round(k2_p, 5) AS k2_p, k2_p >= 0.05 AS k2_normal FROM k2")
def dagostino_k2(spark, d):
    return st.dagostino_k2(ten(spark, d), ["label", "k"], "x").withColumns({c: F.round(c, 5) for c in ("skew", "kurt", "k2", "k2_p")})


@query("shapiro_normality", f"WITH {W} SELECT label, k, round(w, 6) AS w, round(w_p, 5) AS w_p, w_p >= 0.05 AS w_normal FROM wt")
def shapiro_normality(spark, d):
    return st.shapiro_francia(ten(spark, d), ["label", "k"], "x").withColumns({"w": F.round("w", 6), "w_p": F.round("w_p", 5)})


BOTH = K2 + ", " + W.replace(f"{LONG}, ten AS (SELECT * FROM long WHERE k < 10),\n", "")


@query("normality_table", f"WITH {BOTH} SELECT label, k, n, round(k2_p, 5) AS k2_p, k2_p >= 0.05 AS k2_normal, round(w_p, 5) AS w_p, w_p >= 0.05 AS w_normal, round(skew, 5) AS skew, round(kurt, 5) AS kurt FROM k2 JOIN wt USING (label, k) WHERE n >= 8")
def normality_table(spark, d):
    return st.normality_table(long_features(spark, d)).select("label", "k", "n", F.round("k2_p", 5).alias("k2_p"), "k2_normal", F.round("w_p", 5).alias("w_p"), "w_normal", F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query("pass_rate", f"WITH {K2} SELECT label, round(avg((k2_p >= 0.05)::INT), 6) AS pass_rate FROM k2 GROUP BY label")
def pass_rate(spark, d):
    return st.pass_rate(st.dagostino_k2(ten(spark, d), ["label", "k"], "x"), ["label"], "k2_normal").withColumn("pass_rate", F.round("pass_rate", 6))


@query("pivot_pvalues", f"WITH {K2} SELECT k, " + ", ".join(f"round(avg(k2_p) FILTER (label = {c}), 5) AS p_{c}" for c in range(10)) + " FROM k2 GROUP BY k")
def pivot_pvalues(spark, d):
    wide = st.pivot_pvalues(st.dagostino_k2(ten(spark, d), ["label", "k"], "x"), "k", "label", list(range(10)), "k2_p")
    return wide.select("k", *[F.round(f"p_{c}", 5).alias(f"p_{c}") for c in range(10)])
