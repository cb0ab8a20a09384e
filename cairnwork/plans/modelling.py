"""Queries of scaling, losses, models and fusion. Held-out embeddings are the rows, centroid models the cheap classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.functions.hashing import hashed_rank, order_key
from cairnwork.operators import fusion, losses, metrics, mixtures, models, scaling
from cairnwork.plans import evaluation as ev
from cairnwork.plans.base import HOLDOUT, LONG, features, holdout, query, table
from cairnwork.plans.evaluation import CLASSES
from cairnwork.plans.scans import scratch

SPANS = {"net": (0, 16), "ml_a": (16, 32), "ml_b": (32, 48)}


def split(spark, d) -> tuple[DataFrame, DataFrame]:
    held = holdout(spark, d)
    return held.where("split = 'train'").drop("split"), held.where("split = 'test'").drop("split")


@query("standardize", f"WITH {HOLDOUT}, s AS (SELECT k, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM long JOIN held USING (vec_id) WHERE split = 'train' GROUP BY k) SELECT vec_id, k, round((x - m) / s, 5) + 0.0 AS z FROM long JOIN held USING (vec_id) JOIN s USING (k) WHERE split = 'test'")
def standardize(spark, d):
    train, test = split(spark, d)
    return scaling.standardize(test, scaling.fit_scaler(train)).select("vec_id", F.posexplode("v").alias("k", "z")).withColumn("z", F.round("z", 5) + F.lit(0.0))


PROBA = HOLDOUT + f""",
centres AS (SELECT l.label AS class, k, avg(x) AS m FROM long l JOIN held h USING (vec_id) WHERE split = 'train' GROUP BY ALL),
models(model, lo, hi) AS (VALUES {', '.join(f"('{m}', {lo}, {hi})" for m, (lo, hi) in SPANS.items())}),
dist AS (SELECT model, l.vec_id, l.label AS truth, class, -sum((x - m) * (x - m)) AS z FROM long l JOIN held h USING (vec_id) JOIN centres USING (k) JOIN models ON k >= lo AND k < hi WHERE split = 'test' GROUP BY ALL),
proba AS (SELECT model, vec_id, truth, class, z, z - max(z) OVER w AS zz FROM dist WINDOW w AS (PARTITION BY model, vec_id)),
pr AS (SELECT model, vec_id, truth, class, z, exp(zz) / sum(exp(zz)) OVER (PARTITION BY model, vec_id) AS p FROM proba)"""


def probabilities(spark, d) -> DataFrame:
    """vec_id, truth, and arrays net, ml_a, ml_b of logits (z_...) and probabilities over classes in order."""
    train, test = split(spark, d)
    out = None
    for name, span in SPANS.items():
        s = ev.scored(test, train, *span).select("vec_id", F.col("label").alias("truth"), F.col("scores").alias(f"z_{name}"), A.softmax(F.col("scores")).alias(name))
        out = s if out is None else out.join(s.drop("truth"), "vec_id")
    return out


@query("ldam_loss", f"""WITH {PROBA}, mg AS (SELECT label AS class, power(count(*), -0.25::DOUBLE) * 0.5 / max(power(count(*), -0.25::DOUBLE)) OVER () AS m FROM held WHERE split = 'train' GROUP BY label),
sh AS (SELECT vec_id, truth, class, (z - CASE WHEN class = truth THEN m ELSE 0 END) * 0.1 AS s FROM pr JOIN mg USING (class) WHERE model = 'net'),
lp AS (SELECT vec_id, truth, class, s, max(s) OVER w AS top FROM sh WINDOW w AS (PARTITION BY vec_id)),
ll AS (SELECT vec_id, truth, class, s - top - ln(sum(exp(s - top)) OVER (PARTITION BY vec_id)) AS logp FROM lp)
SELECT vec_id, round(-0.9 * max(logp) FILTER (class = truth) - 0.1 * sum(logp) / count(*), 4) AS loss FROM ll GROUP BY vec_id""")
def ldam_loss(spark, d):
    from cairnwork.operators import rebalance

    train, _ = split(spark, d)
    m = rebalance.ldam_margins(train, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "margin"))), lambda s: s["margin"]).alias("margins"))
    rows = probabilities(spark, d).crossJoin(F.broadcast(m))  # one row: a margin a class
    return rows.select("vec_id", F.round(losses.ldam_loss(F.col("z_net"), F.col("truth"), F.col("margins"), 0.1, 0.1), 4).alias("loss"))


@query("distillation_loss", f"""WITH {PROBA}, lg AS (SELECT a.vec_id, a.truth, a.class, a.z / 40 AS s, b.z / 40 AS t FROM pr a JOIN pr b USING (vec_id, class) WHERE a.model = 'net' AND b.model = 'ml_a'),
l AS (SELECT *, s - max(s) OVER w AS s1, s / 4 - max(s / 4) OVER w AS s4, t / 4 - max(t / 4) OVER w AS t4 FROM lg WINDOW w AS (PARTITION BY vec_id)),
n AS (SELECT *, s1 - ln(sum(exp(s1)) OVER w) AS ls, s4 - ln(sum(exp(s4)) OVER w) AS ls4, t4 - ln(sum(exp(t4)) OVER w) AS lt4 FROM l WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, round(0.7 * 16 * sum(exp(lt4) * (lt4 - ls4)) + 0.3 * -max(ls) FILTER (class = truth), 5) AS loss FROM n GROUP BY vec_id""")
def distillation_loss(spark, d):
    p = probabilities(spark, d)
    return p.select("vec_id", F.round(losses.distillation_loss(A.scaled(F.col("z_net"), 1 / 40), A.scaled(F.col("z_ml_a"), 1 / 40), F.col("truth")), 5).alias("loss"))


@query("stack_features", f"""WITH {PROBA}, o(model, o) AS (VALUES ('ml_a', 0), ('ml_b', 1)), g AS (SELECT DISTINCT vec_id, class FROM pr), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT label FROM embeddings))
SELECT g.vec_id, (o.o * n.n + g.class)::INT AS j, round(coalesce(pr.p, 0), 6) AS p FROM g CROSS JOIN o CROSS JOIN n LEFT JOIN pr ON pr.vec_id = g.vec_id AND pr.class = g.class AND pr.model = o.model AND NOT (o.model = 'ml_b' AND g.vec_id % 7 = 0)""")
def stack_features(spark, d):
    p = probabilities(spark, d)
    long = p.select("vec_id", F.lit("ml_a").alias("model"), F.col("ml_a").alias("proba")).unionByName(p.where("vec_id % 7 <> 0").select("vec_id", F.lit("ml_b").alias("model"), F.col("ml_b").alias("proba")))
    stacked = fusion.stack_features(p, long, ["ml_a", "ml_b"], "vec_id", 10)
    return stacked.select("vec_id", F.posexplode("stacked").alias("j", "p")).withColumn("p", F.round("p", 6))


GRID = fusion.blend_grid()


@query("weighted_blend_search", f"""WITH {PROBA}, {CLASSES}, grid(place, w, a, b) AS (VALUES {', '.join(f'({i}, {w}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)' for i, w, (a, b) in GRID)}),
bl AS (SELECT place, vec_id, truth, class, sum(p * CASE model WHEN 'net' THEN w WHEN 'ml_a' THEN a ELSE b END) AS p FROM pr, grid GROUP BY ALL),
preds AS (SELECT place, truth, class AS pred FROM bl QUALIFY row_number() OVER (PARTITION BY place, vec_id ORDER BY round(p, 12) DESC, class) = 1),
c AS (SELECT place, dom.class, count(*) FILTER (truth = dom.class AND pred = dom.class) AS tp, count(*) FILTER (truth = dom.class) AS t, count(*) FILTER (pred = dom.class) AS p FROM preds, dom GROUP BY ALL),
f AS (SELECT place, round(avg(coalesce(2 * tp / nullif(t + p, 0), 0)), 6) AS macro_f1 FROM c GROUP BY place)
SELECT place, w AS w_net, a AS w_a, b AS w_b, macro_f1 FROM f JOIN grid USING (place) ORDER BY macro_f1 DESC, place LIMIT 1""")
def weighted_blend_search(spark, d):
    grid = spark.createDataFrame([(i, w, *ml) for i, w, ml in GRID], "place int, w_net double, w_a double, w_b double")
    crossed = probabilities(spark, d).crossJoin(F.broadcast(grid))  # 22 rows of weights
    mixed = F.zip_with(F.zip_with("net", "ml_a", lambda x, y: x * F.col("w_net") + y * F.col("w_a")), "ml_b", lambda x, y: F.round(x + y * F.col("w_b"), 12))
    preds = crossed.select("place", "truth", A.argmax(mixed).cast("int").alias("pred"))
    f1 = metrics.accuracy_f1(preds, ["place"], ev.domain(spark, d)).select("place", F.round("macro_f1", 6).alias("macro_f1"))
    return fusion.first_best(f1).join(grid, "place").select("place", "w_net", "w_a", "w_b", "macro_f1")


@query("weighted_blend_predict", f"WITH {PROBA}, b AS (SELECT vec_id, class, sum(p * CASE model WHEN 'net' THEN 0.35::DOUBLE WHEN 'ml_a' THEN 0.35::DOUBLE ELSE 0.3::DOUBLE END) AS p FROM pr GROUP BY ALL) SELECT vec_id, arg_max(class, p) AS pred, round(max(p), 6) AS top FROM b GROUP BY vec_id")
def weighted_blend_predict(spark, d):
    b = fusion.weighted_blend(probabilities(spark, d), [0.35, 0.35, 0.3], ["net", "ml_a", "ml_b"])
    return b.select("vec_id", F.col("pred").cast("int").alias("pred"), F.round(F.array_max("blend"), 6).alias("top"))


@query("permutation_importance", f"""WITH {HOLDOUT}, {CLASSES},
centres AS (SELECT l.label AS class, k, avg(x) AS m FROM long l JOIN held h USING (vec_id) WHERE split = 'train' GROUP BY ALL),
t AS (SELECT vec_id, k, x, l.label AS truth FROM long l JOIN held h USING (vec_id) WHERE split = 'test'),
l AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42|' || vec_id)) AS place FROM held WHERE split = 'test'),
o AS (SELECT k AS f, x AS nx, row_number() OVER (PARTITION BY k ORDER BY md5('43|' || k || '|' || vec_id)) AS place FROM t),
mv AS (SELECT vec_id, f, nx FROM l JOIN o USING (place) UNION ALL SELECT vec_id, -1, 0 FROM l),
dist AS (SELECT mv.f, t.vec_id, truth, class, sum(power(CASE WHEN t.k = mv.f THEN nx ELSE x END - m, 2)) AS d2 FROM t JOIN mv USING (vec_id) JOIN centres USING (k) GROUP BY ALL),
preds AS (SELECT f, truth, class AS pred FROM dist QUALIFY row_number() OVER (PARTITION BY f, vec_id ORDER BY d2, class) = 1),
c AS (SELECT f, dom.class, count(*) FILTER (truth = dom.class AND pred = dom.class) AS tp, count(*) FILTER (truth = dom.class) AS t, count(*) FILTER (pred = dom.class) AS p FROM preds, dom GROUP BY ALL),
f1 AS (SELECT f, avg(coalesce(2 * tp / nullif(t + p, 0), 0)) AS macro_f1 FROM c GROUP BY f)
SELECT a.f::INT AS feature, round(b.macro_f1 - a.macro_f1, 6) + 0.0 AS fall FROM f1 a, f1 b WHERE a.f >= 0 AND b.f = -1""")
def permutation_importance(spark, d):
    """The fall of macro-F1 when a feature's values go to other rows, all features in one pass."""
    train, test = split(spark, d)
    left = hashed_rank(test, [], order_key(42, "vec_id"), "place")
    values = test.select(F.col("vec_id").alias("other"), F.posexplode("v").alias("feature", "x"))
    right = hashed_rank(values, ["feature"], order_key(43, "feature", "other"), "place").drop("other")
    moved = left.join(right, "place").withColumn("v", F.transform("v", lambda x, i: F.when(i == F.col("feature"), F.col("x")).otherwise(x)))
    rows = moved.select("vec_id", "label", "v", "feature").unionByName(test.select("vec_id", "label", "v", F.lit(-1).alias("feature")))
    centres = fusion.centroids(train)
    preds = fusion.predicted(fusion.centroid_scores(rows, centres)).select("feature", F.col("label").alias("truth"), "pred")
    f1 = metrics.accuracy_f1(preds, ["feature"], ev.domain(spark, d))
    base = f1.where("feature = -1").select(F.col("macro_f1").alias("base"))
    return f1.where("feature >= 0").crossJoin(base).select("feature", (F.round(F.col("base") - F.col("macro_f1"), 6) + F.lit(0.0)).alias("fall"))  # base is a row


GMM = HOLDOUT + """, par AS (SELECT l.label AS class, vec_id % 2 AS comp, k, avg(x) AS m FROM long l JOIN held h USING (vec_id) WHERE split = 'train' GROUP BY ALL),
vr AS (SELECT l.label AS class, k, var_pop(x) + 0.001 AS s FROM long l JOIN held h USING (vec_id) WHERE split = 'train' GROUP BY ALL),
pri AS (SELECT label AS class, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS prior FROM held WHERE split = 'train' GROUP BY label),
ld AS (SELECT l.vec_id, par.class, comp, ln(0.5) - 0.5 * sum((x - m) * (x - m) / s + ln(2 * pi() * s)) AS lp FROM long l JOIN held h USING (vec_id) JOIN par USING (k) JOIN vr ON vr.class = par.class AND vr.k = l.k WHERE split = 'test' GROUP BY ALL),
tp AS (SELECT *, max(lp) OVER (PARTITION BY vec_id, class) AS top FROM ld), sc AS (SELECT vec_id, class, any_value(top) + ln(sum(exp(lp - top))) + ln(any_value(prior)) AS score FROM tp JOIN pri USING (class) GROUP BY ALL)"""


def given_mixture(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test rows, a mixture of two components a class (rows of even and odd id), inverse priors."""
    train, test = split(spark, d)
    means = fusion.centroids(train.withColumn("class_comp", F.struct("label", F.pmod("vec_id", F.lit(2)).cast("int").alias("comp"))), "class_comp")
    spread = train.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg((F.var_pop("x") + 0.001).alias("s")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda s: s["s"]).alias("var"))
    params = means.select(F.col("class_comp.label").alias("label"), F.col("class_comp.comp").alias("comp"), F.lit(0.5).alias("weight"), F.col("centre").alias("mean")).join(spread, "label").withColumnRenamed("label", "class")
    return test, params, mixtures.inverse_priors(train)


@query("gmm_score", f"WITH {GMM} SELECT vec_id, class, round(score, 4) AS score FROM sc")
def gmm_score(spark, d):
    s = mixtures.gmm_scores(*given_mixture(spark, d))
    return s.select("vec_id", F.explode(F.arrays_zip("classes", "scores")).alias("z")).select("vec_id", F.col("z.classes").alias("class"), F.round("z.scores", 4).alias("score"))


def fitted_mixture(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = split(spark, d)
    scaler = scaling.fit_scaler(train)
    train, test = scaling.standardize(train, scaler), scaling.standardize(test, scaler)
    return test, mixtures.fit_gmm(train, "vec_id"), mixtures.inverse_priors(train)


@query("gmm_classifier")
def gmm_classifier(spark, d):
    s = mixtures.gmm_scores(*fitted_mixture(spark, d))
    return fusion.predicted(s).select("vec_id", F.col("label").alias("truth"), "pred", F.array_max(A.softmax(F.col("scores"))).alias("top"))


@query("gmm_effective_components")
def gmm_effective_components(spark, d):
    return mixtures.effective_components(fitted_mixture(spark, d)[1])


@query("hmm_init", """WITH n AS (SELECT conv_id, conv_id % 2 AS class, count(*) AS n FROM conversations GROUP BY ALL), s AS (SELECT class, least(8, min(n)) AS states FROM n GROUP BY class)
SELECT class::INT AS class, i::INT AS i, j::INT AS j, CASE WHEN i = j AND i = states - 1 THEN 1.0 WHEN i = j THEN 0.7 WHEN j = i + 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS p FROM s, range(8) a(i), range(8) b(j) WHERE i < states AND j < states""")
def hmm_init(spark, d):
    """The start matrix of each class: at most 8 states, no more than its shortest sequence has values."""
    states = sequences(spark, d).groupBy("class").agg(F.least(F.lit(8), F.min(F.size("x"))).alias("states"))
    made = None
    for row in states.collect():  # a row a class
        one = mixtures.hmm_init(spark, row["states"]).select(F.lit(row["class"]).alias("class"), "i", "j", F.round("p", 6).alias("p"))
        made = one if made is None else made.unionByName(one)
    return made


def sequences(spark, d) -> DataFrame:
    """conv_id, class (parity), x: the lengths of a conversation's turns, in units of 100."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") / 100).alias("len"))
    x = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "len"))), lambda s: s["len"]).alias("x"))
    return x.select("conv_id", F.pmod("conv_id", F.lit(2)).cast("int").alias("class"), "x")


@query("hmm_fit")
def hmm_fit(spark, d):
    """round, class, log_likelihood, which never falls by more than rounding and the variance floor allow."""
    _, history = mixtures.fit_hmm(sequences(spark, d).cache())
    return spark.createDataFrame([(k, c, ll) for k, h in enumerate(history) for c, ll in sorted(h.items())], "round int, class int, log_likelihood double")


GIVEN = {0: (1.0, 3.0, 6.0), 1: (0.5, 2.0, 8.0)}


@query("hmm_score", """WITH RECURSIVE m(class, m0, m1, m2) AS (VALUES (0, 1.0::DOUBLE, 3.0::DOUBLE, 6.0::DOUBLE), (1, 0.5, 2.0, 8.0)),
x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, length(text) / 100 AS x FROM conversations),
b AS (SELECT conv_id, t, class, exp(-0.5 * (x - m0) * (x - m0) / 4) / sqrt(8 * pi()) AS b0, exp(-0.5 * (x - m1) * (x - m1) / 4) / sqrt(8 * pi()) AS b1, exp(-0.5 * (x - m2) * (x - m2) / 4) / sqrt(8 * pi()) AS b2, -0.5 / 4 * least((x - m0) * (x - m0), (x - m1) * (x - m1), (x - m2) * (x - m2)) AS lo, x, m0, m1, m2 FROM x, m),
e AS (SELECT conv_id, t, class, lo, exp(-0.5 / 4 * (x - m0) * (x - m0) - lo) / sqrt(8 * pi()) AS e0, exp(-0.5 / 4 * (x - m1) * (x - m1) - lo) / sqrt(8 * pi()) AS e1, exp(-0.5 / 4 * (x - m2) * (x - m2) - lo) / sqrt(8 * pi()) AS e2 FROM b),
f AS (SELECT conv_id, class, t, 1.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, ln(e0) + lo AS ll FROM e WHERE t = 1
UNION ALL SELECT conv_id, class, t, n0 / (n0 + n1 + n2), n1 / (n0 + n1 + n2), n2 / (n0 + n1 + n2), ll + lo + ln(n0 + n1 + n2) FROM (SELECT f.conv_id, f.class, e.t, f.ll, e.lo, a0 * 0.7 * e0 AS n0, (a0 * 0.3 + a1 * 0.7) * e1 AS n1, (a1 * 0.3 + a2) * e2 AS n2 FROM f JOIN e ON e.conv_id = f.conv_id AND e.class = f.class AND e.t = f.t + 1)),
l AS (SELECT conv_id, class, arg_max(ll, t) AS ll FROM f GROUP BY ALL)
SELECT conv_id, class, round(ll, 4) AS score FROM l""")
def hmm_score(spark, d):
    import numpy as np

    move = np.array([[0.7, 0.3, 0.0], [0.0, 0.7, 0.3], [0.0, 0.0, 1.0]])
    params = {c: (np.eye(3)[0], move, np.array(m), np.full(3, 4.0)) for c, m in GIVEN.items()}
    s = mixtures.hmm_score(sequences(spark, d), params)
    return s.select("conv_id", F.posexplode("scores").alias("class", "score")).withColumn("score", F.round("score", 4))


def predictions(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "truth", "pred", F.array_max("proba").alias("top"))


@query("random_forest")
def random_forest(spark, d):
    train, test = split(spark, d)
    return predictions(models.Forest(train, "vec_id").predict(test, "vec_id"))


@query("boosted_trees")
def boosted_trees(spark, d):
    train, test = split(spark, d)
    return predictions(models.BoostedTrees(train, key="vec_id").predict(test, "vec_id"))


@query("kernel_svm")
def kernel_svm(spark, d):
    train, test = split(spark, d)
    return predictions(models.KernelSVM(train, "vec_id").predict(test, "vec_id"))


@query("grid_search_cv")
def grid_search_cv(spark, d):
    """The smaller of the surveyed grids: C and gamma of the kernel machine, over all features."""
    scores = models.grid_search_cv(features(spark, d), "vec_id", {"c": [1, 10, 100], "gamma": ["scale", 0.01]}, folds=3)
    return models.best_parameters(scores, ["c", "gamma"])


#: Features that the centroid models of the grid see, from the first on.
WIDTHS = (4, 8, 16, 32, 64)


@query("grid_selection", f"""WITH {LONG}, {CLASSES}, ids AS (SELECT vec_id, label FROM embeddings),
dealt AS (SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) - 1) % 3 AS fold FROM ids),
g AS (SELECT unnest(range(3)) AS fold), w(place, width) AS (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(WIDTHS))}),
centres AS (SELECT g.fold, l.label AS class, k, avg(x) AS m FROM g JOIN dealt s ON s.fold <> g.fold JOIN long l USING (vec_id) GROUP BY ALL),
dist AS (SELECT place, s.fold, l.vec_id, l.label AS truth, class, sum((x - m) * (x - m)) AS d2 FROM dealt s JOIN long l USING (vec_id) JOIN centres c ON c.fold = s.fold AND c.k = l.k JOIN w ON l.k < width GROUP BY ALL),
preds AS (SELECT place, fold, truth, class AS pred FROM dist QUALIFY row_number() OVER (PARTITION BY place, fold, vec_id ORDER BY d2, class) = 1),
c AS (SELECT place, fold, dom.class, count(*) FILTER (truth = dom.class AND pred = dom.class) AS tp, count(*) FILTER (truth = dom.class) AS t, count(*) FILTER (pred = dom.class) AS p FROM preds, dom GROUP BY ALL),
f AS (SELECT place, fold, avg(2 * tp / (t + p)) AS f1 FROM c WHERE t + p > 0 GROUP BY ALL)
SELECT place, width::DOUBLE AS width, round(avg(f1), 6) AS macro_f1 FROM f JOIN w USING (place) GROUP BY ALL ORDER BY macro_f1 DESC, place LIMIT 1""")
def grid_selection(spark, d):
    """The same folds, scores and choice of parameters for models that SQL can say: centroids of the first features."""
    from cairnwork.operators import splits

    dealt = splits.stratified_kfold(features(spark, d), "label", "vec_id", 3)
    out = None
    for fold in range(3):
        train, test = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        for place, width in enumerate(WIDTHS):
            found = fusion.predicted(ev.scored(test, train, 0, width)).select(F.lit(place).alias("place"), F.lit(fold).alias("fold"), F.col("label").alias("truth"), "pred")
            out = found if out is None else out.unionByName(found)
    best = models.best_parameters(models.scored_grid(out, ["width"], [(w,) for w in WIDTHS]), ["width"])
    return best.withColumn("macro_f1", F.round("macro_f1", 6))


@query("feature_importance")
def feature_importance(spark, d):
    train, _ = split(spark, d)
    return models.feature_importance(models.Forest(train, "vec_id"), [f"e{k}" for k in range(64)], spark)


@query("stacking_fit")
def stacking_fit(spark, d):
    """Out-of-fold probabilities of two base models on the training rows fit a logistic regression; it predicts the rows held out, from bases fitted on all training rows."""
    from cairnwork.operators import splits

    train, test = split(spark, d)

    def bases(rows, fitted):
        a = ev.scored(rows, fitted, 0, 32).select("vec_id", "label", A.softmax(F.col("scores")).alias("a"))
        b = ev.scored(rows, fitted, 32, 64).select("vec_id", A.softmax(F.col("scores")).alias("b"))
        return a.join(b, "vec_id").select("vec_id", "label", F.concat("a", "b").alias("v"))

    dealt = splits.stratified_kfold(train.select("vec_id", "label", "v"), "label", "vec_id", 2)
    parts = [bases(dealt.where(F.col("fold") == fold), dealt.where(F.col("fold") != fold)) for fold in range(2)]
    return predictions(models.scored(models.logistic(parts[0].unionByName(parts[1]), iterations=30, reg=1e-3), bases(test, train), "vec_id"))


@query("soft_label_fit")
def soft_label_fit(spark, d):
    train, test = split(spark, d)
    teacher = ev.scored(train, train, 0, 64).select("vec_id", A.softmax(A.scaled(F.col("scores"), 0.25)).alias("proba"))
    return predictions(models.scored(models.soft_label_fit(train, teacher, "vec_id", 20), test, "vec_id"))


@query("two_stage_classifier")
def two_stage_classifier(spark, d):
    train, test = split(spark, d)
    return models.TwoStage(train, majority=0).predict(test, "vec_id")


@query("mlp_classifier")
def mlp_classifier(spark, d):
    train, test = split(spark, d)
    return predictions(models.scored(models.mlp(train), test, "vec_id"))


@query("project_2d")
def project_2d(spark, d):
    return models.project_2d(features(spark, d), "vec_id")


@query("model_save_load")
def model_save_load(spark, d):
    """kind, id, pred and pred_back: predictions of fitted models of every kind and of those read back; they are equal. All are small: storing them is what the query is about."""
    train, test = split(spark, d)
    out = []

    def compare(kind: str, a, b, key: str = "vec_id") -> None:
        b = b.select(F.col(key).alias("__key"), F.col("pred").alias("pred_back"))
        out.append(a.join(b, F.col(key) == F.col("__key")).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("pred").cast("int").alias("pred"), F.col("pred_back").cast("int").alias("pred_back")))

    for kind, model in (("logistic", models.logistic(train, iterations=10)), ("mlp", models.mlp(train, (16,), 10))):
        models.save(model, path := scratch(spark, f"model-{kind}"))
        compare(kind, models.scored(model, test, "vec_id"), models.scored(models.load(path), test, "vec_id"))
    own = {
        "two_stage": models.TwoStage(train, majority=0), "forest": models.Forest(train, "vec_id", trees=20, depth=6), "boosted": models.BoostedTrees(train, rounds=3, depth=3, key="vec_id"),
        "kernel_svm": models.KernelSVM(train, "vec_id", features=32, iterations=5),
    }
    for kind, model in own.items():
        models.save(model, path := scratch(spark, f"model-{kind}"))
        compare(kind, model.predict(test, "vec_id"), models.load(path).predict(test, "vec_id"))
    params, priors = mixtures.fit_gmm(train, "vec_id", rounds=1), mixtures.inverse_priors(train)
    mixtures.save_gmm(params, path := scratch(spark, "model-gmm"))
    compare("gmm", *(fusion.predicted(mixtures.gmm_scores(test, p, priors)) for p in (params, mixtures.load_gmm(spark, path))))
    turns = sequences(spark, d).cache()
    fitted, _ = mixtures.fit_hmm(turns, rounds=2)
    mixtures.save_hmm(spark, fitted, path := scratch(spark, "model-hmm"))
    compare("hmm", *(mixtures.hmm_score(turns, p).select("conv_id", "pred") for p in (fitted, mixtures.load_hmm(spark, path))), "conv_id")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
