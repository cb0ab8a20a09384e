"""Operators on small frames with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.functions.hashing import hashed_rank, order_key
from cairnwork.operators import frames, fusion, losses, metrics, mixtures, models, profile, quality, rebalance, spectral, splits, stattests, transforms
from cairnwork.sources import files, stores


def preds(spark, pairs):
    return spark.createDataFrame([(int(t), int(p)) for t, p in pairs], "truth int, pred int")


HYBRID = [(0, 0)] * 61 + [(3, 3)] + [(3, 0)] * 3 + [(4, 4), (4, 0)] + [(2, 0)]


def test_macro_f1_over_observed_and_full_domain(spark):
    p = preds(spark, HYBRID)
    domain = spark.range(5).select(F.col("id").cast("int").alias("idx"))
    assert round(metrics.accuracy_f1(p).first().macro_f1, 4) == 0.5068
    assert round(metrics.accuracy_f1(p, domain=domain).first().macro_f1, 4) == 0.4055
    p = p.withColumn("model", F.lit("m"))
    one = metrics.evaluate(p, ["model"], domain).first()
    assert round(one.macro_f1, 4) == 0.4055 and round(one.mcc, 6) == round(metrics.mcc(p).first().mcc, 6) and round(one.kappa, 6) == round(metrics.cohen_kappa(p).first().kappa, 6)


def test_constant_predictions_score_zero(spark):
    p = preds(spark, [(0, 0), (0, 0)])
    assert metrics.mcc(p).first().mcc == 0 and metrics.cohen_kappa(p).first().kappa == 0


def test_auc_ties_and_missing_positives(spark):
    rows = [(0, 0, 0.9), (1, 0, 0.9), (1, 0, 0.1), (0, 1, 0.1), (1, 1, 0.1), (1, 1, 0.9)]
    df = spark.createDataFrame(rows, "truth int, class int, score double")
    assert metrics.auc_ovr_macro(df).first().auc == pytest.approx(0.75)
    assert metrics.auc_ovr_macro(df.withColumn("truth", F.lit(0))).first().auc is None


def test_stratified_quota(spark):
    counts = {0: 382, 1: 16, 2: 8, 3: 27, 4: 24}
    df = spark.createDataFrame([(f"{c}-{i}", c) for c, n in counts.items() for i in range(n)], "key string, label int")
    held = splits.stratified_holdout(df, "label", "key")
    assert {r.label: r["count"] for r in held.where("split = 'test'").groupBy("label").count().collect()} == {0: 77, 1: 3, 2: 2, 3: 5, 4: 5}
    assert held.count() == 457 and set(held.columns) == {"key", "label", "split"}


def test_hashed_rank_is_a_permutation(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    ranked = hashed_rank(df, ["g"], order_key(1, "id"), "r")
    for g in range(3):
        got = [r.r for r in ranked.where(f"g = {g}").orderBy(order_key(1, "id")).collect()]
        assert got == list(range(1, len(got) + 1))


def test_groups_never_split_and_leaks_raise(spark):
    df = spark.range(300).select((F.col("id") % 20).alias("g"))
    held = splits.grouped_holdout(df, "g")
    assert splits.assert_no_leakage(held, "g", "split").count() == 3
    assert {r.split: r.n for r in held.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"test": 3, "val": 3, "train": 14}
    bad = spark.createDataFrame([("a", "train"), ("a", "test")], "g string, split string")
    with pytest.raises(ValueError):
        splits.assert_no_leakage(bad, "g", "split")


def test_plans(spark):
    df = spark.createDataFrame([(i, 0) for i in range(400)] + [(1000 + i, 1) for i in range(8)] + [(2000, 2)], "key long, label int")
    major = rebalance.augment_plan_major(df, "label", "key", 300, dominant=0)
    n = {r.label: r["count"] for r in major.groupBy("label").count().collect()}
    assert n == {1: 292, 2: 299}
    first = [r.parent for r in major.where("label = 1").orderBy("i").limit(18).collect()]
    assert first == [1000] * 17 + [1001]
    assert rebalance.augment_plan_single_pass(df, "label", "key", 300, 0).where("label = 1").count() == 136
    robin = rebalance.augment_plan_round_robin(df, "label", "key", 384)
    assert {r.label: r["count"] for r in robin.groupBy("label").count().collect()} == {1: 376, 2: 383}
    assert {len(set(r.transforms.split("+"))) for r in robin.collect()} == {2, 3}


def test_smote_guards_single_rows(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(6)] + [(10, 1, [0.0, 0.0]), (11, 1, [2.0, 2.0])] + [(20, 2, [9.0, 9.0])]
    made = rebalance.smote(spark.createDataFrame(rows, "key long, label int, v array<double>"), "key", "v", "label").collect()
    assert {r.label for r in made} == {1} and len(made) == 4
    assert all(r.synthetic[0] == r.synthetic[1] and 0 <= r.synthetic[0] <= 2 for r in made)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {r.label: r.weight for r in rebalance.class_weights(df, "label", [0, 1, 2]).collect()} == {0: pytest.approx(8 / 18), 1: pytest.approx(8 / 6), 2: pytest.approx(8 / 3)}
    assert max(r.margin for r in rebalance.ldam_margins(df, "label").collect()) == 0.5


def test_arrays(spark):
    r = spark.createDataFrame([([1.0, float("nan"), float("inf")],)], "x array<double>").select(
        A.fix_length(F.col("x"), 2).alias("a"), F.size(A.fix_length(F.col("x"), 5)).alias("b"), A.nonfinite_to_zero(F.col("x")).alias("c"),
        A.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("d"), A.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("e")).first()
    assert r.b == 5 and r.c == [1.0, 0.0, 0.0] and r.d == 1 and r.e == [0.5, 0.5]


def series(spark, xs, key=1):
    return spark.createDataFrame([(key, t, float(x)) for t, x in enumerate(xs)], "series_id long, t long, x double")


def test_last_full_frame_is_left_out(spark):
    f = frames.frame_series(series(spark, range(32)), 16, 8)
    assert sorted({r.frame for r in f.collect()}) == [0, 1]  # starts 0 and 8; 16 = n - length is left out
    assert frames.frame_series(series(spark, range(16)), 16, 8).count() == 0


def test_silent_and_constant_series(spark):
    zero = frames.frame_arrays(series(spark, [0] * 40), 16, 8)
    assert frames.hnr(zero, 16).first().hnr == 0 and frames.shimmer(zero).first().shimmer == 0
    f0 = frames.f0_track(zero, 16.0, 2, 8)
    assert f0.count() == 0 and frames.f0_summary(zero, f0).first().f0_mean == 0
    const = frames.frame_arrays(series(spark, [2] * 40), 16, 8)
    assert frames.shimmer(const).first().shimmer == 0
    assert quality.silence_filter(series(spark, [0] * 4)).first().silent


def test_spectrum_forms_agree_and_cosine_peaks(spark):
    xs = [math.cos(2 * math.pi * 4 * t / 16) for t in range(64)]
    f = frames.frame_arrays(series(spark, xs), 16, 8)
    a = {r.frame: r.p for r in spectral.power_spectrum(f, 16).collect()}
    b = {r.frame: r.p for r in spectral.power_spectrum(f, 16, literal_points=0).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) and int(np.argmax(a[k])) == 4 for k in a)


def test_delta_of_a_line(spark):
    c = spark.createDataFrame([(1, f, [3.0 * f, 1.0]) for f in range(12)] + [(2, f, [float(f), 0.0]) for f in range(4)], "series_id long, frame long, c array<double>")
    d = spectral.delta(c, 1).collect()
    assert all(np.allclose(r.d, [3.0, 0.0]) for r in d if r.series_id == 1) and all(r.d == [0.0, 0.0] for r in d if r.series_id == 2)
    q = spark.createDataFrame([(1, f, [2.0 * f * f]) for f in range(12)], "series_id long, frame long, c array<double>")
    assert all(np.allclose(r.d, [4.0]) for r in spectral.delta(q, 2).collect())


def test_transforms(spark):
    s = series(spark, range(1, 41))
    noisy = transforms.add_noise_snr(s, 20.0).collect()
    x, y = np.array([r.x for r in noisy]), np.array([r.y for r in noisy])
    assert 10 * math.log10((x**2).mean() / ((y - x) ** 2).mean()) == pytest.approx(20)
    transforms.register("double", lambda x: x * 2)
    out = transforms.compose(s, ["double", "shift_right"]).orderBy("t").collect()
    assert [r.x for r in out[:6]] == [0, 0, 0, 0, 2, 4]


def test_statistics(spark):
    rng = np.random.default_rng(0)
    walk, noise = np.cumsum(rng.normal(size=400)), rng.normal(size=400)
    s = series(spark, walk, 1).union(series(spark, noise, 2)).union(series(spark, [1.0] * 30, 3))
    lag0 = {r.series_id: r for r in stattests.adf_lag0(s).collect()}
    assert not lag0[1].stationary and lag0[2].stationary and 3 not in lag0
    aic = {r.series_id: r for r in stattests.adf_aic(s).collect()}
    assert not aic[1].stationary and aic[2].stationary and aic[3].stationary is None and aic[3].error
    df = spark.createDataFrame([(0, float(x)) for x in noise] + [(1, float(np.exp(2 * x))) for x in noise] + [(2, float(x)) for x in noise[:10]], "g int, x double")
    k2 = {r.g: r for r in stattests.dagostino_k2(df, ["g"], "x").collect()}
    assert k2[0].k2_normal and not k2[1].k2_normal and k2[2].k2 is None
    w = {r.g: r for r in stattests.shapiro_francia(df, ["g"], "x").collect()}
    assert w[0].w_normal and not w[1].w_normal


def test_losses(spark):
    r = spark.createDataFrame([([2.0, 0.0], 0, [0.5, 0.1])], "z array<double>, y int, m array<double>").select(
        losses.ldam_loss(F.col("z"), F.col("y"), F.col("m"), 1.0).alias("a"), losses.distillation_loss(F.col("z"), F.col("z"), F.col("y")).alias("b")).first()
    assert r.a == pytest.approx(math.log(1 + math.exp(-1.5))) and r.b == pytest.approx(0.3 * math.log(1 + math.exp(-2)))


def test_blend_grid():
    grid = fusion.blend_grid()
    assert len(grid) == 22 and grid[-1][2] == [0.15, -0.05]


def test_stack_fills_missing_models(spark):
    rows = spark.createDataFrame([(1,), (2,)], "key long")
    p = spark.createDataFrame([(1, "a", [0.2, 0.8]), (2, "a", [0.5, 0.5]), (1, "b", [1.0, 0.0])], "key long, model string, proba array<double>")
    got = {r.key: r.stacked for r in fusion.stack_features(rows, p, ["a", "b"], "key", 2).collect()}
    assert got == {1: [0.2, 0.8, 1.0, 0.0], 2: [0.5, 0.5, 0.0, 0.0]}


def test_hmm_likelihood_never_falls(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 2, [float(x) for x in np.r_[rng.normal(0, 1, 5), rng.normal(5 + 3 * (k % 2), 1, 5)]]) for k in range(20)]
    seq = spark.createDataFrame(rows, "class int, x array<double>")
    params, history = mixtures.fit_hmm(seq, states=2, rounds=5, reg=1e-6)
    for c in (0, 1):
        ll = [h[c] for h in history]
        assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:], strict=False))
    scored = mixtures.hmm_score(seq, params).collect()
    assert sum(r["pred"] == r["class"] for r in scored) >= 18
    start, move, mean, var = params[0]
    ll = mixtures.forward_backward(np.array([rows[0][1]]), np.array([len(rows[0][1])]), start, move, mean, var)[0][0]
    assert next(r.scores[0] for r in scored if r.x == rows[0][1]) == pytest.approx(ll, abs=1e-6)


def test_gmm_separates(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k % 2, [float(x) for x in rng.normal(4 * (k % 2), 1, 3)]) for k in range(80)]
    df = spark.createDataFrame(rows, "key long, label int, v array<double>")
    params = mixtures.fit_gmm(df, "key", rounds=3, most=2)
    got = fusion.predicted(mixtures.gmm_scores(df, params, mixtures.inverse_priors(df))).collect()
    assert sum(r.pred == r.label for r in got) >= 76
    assert sum(p.weight for p in params.where("class = 0").collect()) == pytest.approx(1)


def test_gmm_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(k, k % 2, [float(x) for x in rng.normal(k % 2 + (k % 3) / 2, 1, 64)]) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, label int, v array<double>")
    first, got = ({(p["class"], p.comp): p for p in mixtures.fit_gmm(df, "key", rounds=n).collect()} for n in (0, 2))
    for label in (0, 1):
        x = np.array([v for _, y, v in rows if y == label])
        own = [first[label, c] for c in range(6)]
        weight, mean, var = np.array([p.weight for p in own]), np.array([p["mean"] for p in own]), np.array([p["var"] for p in own])
        for _ in range(2):
            lp = np.log(weight) - 0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * np.pi * var)).sum(2)
            share = np.exp(lp - np.logaddexp.reduce(lp, axis=1, keepdims=True))
            n = share.sum(0)
            weight, mean = n / len(x), share.T @ x / n[:, None]
            var = np.maximum(share.T @ x**2 / n[:, None] - mean**2, 0) + 1e-3
        for c in range(6):
            assert got[label, c].weight == pytest.approx(weight[c], abs=1e-9)
            assert got[label, c]["mean"] == pytest.approx(mean[c], abs=1e-6) and got[label, c]["var"] == pytest.approx(var[c], abs=1e-6)


def test_fitted_queries_take_all_features(spark, monkeypatch):
    from cairnwork.plans import modelling
    from tests.conftest import DATA

    seen = []
    monkeypatch.setattr(modelling.mixtures, "fit_gmm", lambda train, key, **given: seen.append((train.select(F.size("v")).first()[0], given)) or train)
    modelling.fitted_mixture(spark, DATA)
    assert seen == [(64, {})]


def test_grid_search_query(spark):
    """The registered query itself: it ends soon, and its score is the mean of its folds' scores, worked out from predictions."""
    import time

    from cairnwork.plans.base import features
    from cairnwork.plans.registry import QUERIES
    from tests.conftest import DATA

    began = time.time()
    best = QUERIES["grid_search_cv"](spark, DATA).collect()
    assert time.time() - began < 180 and len(best) == 1
    scores = models.grid_search_cv(features(spark, DATA), "vec_id", {"c": [1, 10, 100], "gamma": ["scale", 0.01]}).collect()
    assert len(scores) == 18
    mean = {}
    for r in scores:
        mean.setdefault((r.place, r.c, r.gamma), []).append(r.macro_f1)
    top = max(mean, key=lambda m: (round(sum(mean[m]) / 3, 12), -m[0]))
    assert (best[0].place, best[0].c, best[0].gamma) == top and best[0].macro_f1 == pytest.approx(sum(mean[top]) / 3)


def test_machines_minimise_their_loss(spark):
    """Against long gradient descent, a machine at a time, in plain numpy; groups, a class without rows, unlabelled rows."""
    from cairnwork.operators import machines

    rng = np.random.default_rng(1)
    rows = [(g, c, [float(x) for x in rng.normal(1.2 * c, 1, 3)]) for g in (0, 1) for c in (0, 1, 2) for _ in range(25) if (g, c) != (1, 2)]
    df = spark.createDataFrame([*rows, (0, None, [0.0, 0.0, 0.0]), (0, 9, [0.0, 0.0, 0.0])], "group int, label int, v array<double>").repartition(3)
    settings = [machines.Setting(g, c, gamma) for g in (0, 1) for c in (0.5, 5.0) for gamma in (0.1, 0.4)]
    found = machines.fit(df, settings, 3, [0, 1, 2], features=12, iterations=400, tolerance=1e-9)
    for s, setting in enumerate(settings):
        for p, (i, j) in enumerate(found.pairs):
            own = [(c, v) for g, c, v in rows if g == setting.group and c in (i, j)]
            z, y = found.mapped(np.array([v for _, v in own]), setting.gamma), np.array([1.0 if c == i else -1.0 for c, _ in own])
            loss = lambda w: 0.5 * (w[:-1] ** 2).sum() + setting.c * (np.maximum(0, 1 - y * (z @ w)) ** 2).sum()  # noqa: B023, E731
            w = np.zeros(13)
            h = np.linalg.inv(np.diag([1.0] * 12 + [1e-8]) + 2 * setting.c * z.T @ z)
            for _ in range(3000):
                short = np.minimum(y * (z @ w) - 1, 0) * y
                w = w - h @ (np.r_[w[:-1], 1e-8 * w[-1]] + 2 * setting.c * z.T @ short)
            assert loss(found.weights[s, p]) <= loss(w) * (1 + 1e-6) + 1e-9
    few = machines.fit(df, settings, 3, [0, 1, 2], features=12, iterations=30)
    keyed = df.where("label IN (0, 1, 2)").withColumn("key", F.monotonically_increasing_id())
    out = machines.predict(keyed, "key", few).collect()
    assert len(out) == 4 * len(rows)
    assert all(sum(r.truth == r.pred for r in out if r.setting == s) > 0.6 * sum(r.setting == s for r in out) for s in range(8))


def test_smote_within_folds(spark):
    rng = np.random.default_rng(8)
    rows = [(k, g, f"{g}|{c}", [float(x) for x in rng.normal(c, 1, 3)]) for g in (0, 1) for k, c in enumerate([0] * (9 + 4 * g) + [1] * 4 + [2])]
    df = spark.createDataFrame(rows, "key long, fold int, class string, v array<double>")
    made = rebalance.smote(df, "key", "v", "class", within="fold").collect()
    assert {c: sum(r["class"] == c for r in made) for c in ("0|1", "1|1")} == {"0|1": 5, "1|1": 9} and {r["class"] for r in made} == {"0|1", "1|1"}
    by = {(c, k): v for k, _, c, v in rows}
    for r in made:
        assert np.allclose(r.synthetic, np.array(by[r["class"], r.base]) + r.u * (np.array(by[r["class"], r.neighbour]) - np.array(by[r["class"], r.base])))


def test_grid_of_kernel_machines(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, k % 2, [float(x) for x in rng.normal(3 * (k % 2), 1, 4)]) for k in range(60)], "key long, label int, v array<double>")
    scores = models.grid_search_cv(df, "key", {"c": [1], "gamma": ["scale", 0.01]}, folds=2)
    assert sorted((r.place, r.c, r.gamma, r.fold) for r in scores.collect()) == [(0, 1.0, "scale", 0), (0, 1.0, "scale", 1), (1, 1.0, "0.01", 0), (1, 1.0, "0.01", 1)]
    assert models.best_parameters(scores, ["c", "gamma"]).first().macro_f1 > 0.8


def test_models_round_trip_and_stages(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(k, k % 3, [float(x) for x in rng.normal(3 * (k % 3), 1, 4)]) for k in range(150)]
    df = spark.createDataFrame(rows, "key long, label int, v array<double>").repartition(2).cache()
    model = models.logistic(df, 20)
    models.save(model, f"file://{tmp_path}/m")
    a, b = models.scored(model, df, "key").collect(), models.scored(models.load(f"file://{tmp_path}/m"), df, "key").collect()
    assert [(r.key, r.pred) for r in sorted(a)] == [(r.key, r.pred) for r in sorted(b)]
    for found in (models.TwoStage(df, 0).predict(df, "key"), models.KernelSVM(df, "key", features=16, iterations=5).predict(df, "key"), models.scored(models.random_forest(df, 5, 5), df, "key")):
        rows_ = found.collect()
        assert sum(r.truth == r.pred for r in rows_) / len(rows_) > 0.85
    moved = models.permuted(df, "key", 1)
    assert sorted(r.v[1] for r in moved.collect()) == sorted(r.v[1] for r in df.collect())


def test_files(spark, tmp_path):
    for name in ("owl/a-1.wav", "owl/b_aug_x.WAV", "cat/c.mp3", "cat/notes.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"12345")
    found = files.scan_labelled_files(spark, f"file://{tmp_path}", ["owl", "cat", "dog"])
    assert sorted((r.label, r.stem, r.extension, r.length) for r in found.collect()) == [("cat", "c", "mp3", 5), ("owl", "a-1", "wav", 5), ("owl", "b_aug_x", "wav", 5)]
    assert [r.stem for r in files.filter_originals(found, extension="wav").collect()] == ["a-1"]
    key = spark.createDataFrame([("ABCDEF01-2345-6789-ABCD-EF0123456789-17-x_aug_shift",)], "s string").select(files.group_key(F.col("s")).alias("k")).first().k
    assert key == "abcdef01-2345-6789-abcd-ef0123456789"
    labels = spark.createDataFrame([("b",), ("z",), (None,)], "l string")
    assert [r.label_idx for r in files.encode_label(labels, "l", ["a", "b"]).collect()] == [1, None, None]
    assert stores.purge_derived(found, "stem", f"file://{tmp_path}/out") == 1
    made = []
    for _ in range(2):
        stores.load_or_make(spark, f"file://{tmp_path}/fs", "t", lambda: made.append(1) or spark.createDataFrame([(1, [1.0])], "key long, v array<double>"))
    assert len(made) == 1


def test_quality_policies(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None)], "k long, x double")
    good, bad = quality.quarantine(df, F.isnan("x") | F.col("x").isNull())
    assert good.count() == 1 and bad.count() == 2
    assert quality.on_error(df, F.isnan("x"), ["x"], "drop").count() == 2
    assert [r.x for r in quality.on_error(df, F.isnan("x"), ["x"], "zero").orderBy("k").collect()] == [5.0, 0.0, None]
    assert quality.length_audit(df.withColumn("n", F.col("k")), "n", 2).first().asDict()["padded"] == 1


def test_profiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 10]], "x double")
    h = {r.bin: r.n for r in profile.histogram_bins(df, "x", 5).collect()}
    assert h == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}
    box = profile.five_number_summary(df.withColumn("g", F.lit(1)), ["g"], "x").first()
    assert (box.low, box.high) == (0.0, 2.0)
    log = spark.createDataFrame([(e, s) for e, s in enumerate([0.1, 0.3, 0.2, 0.2, 0.3])], "epoch long, score double")
    out = metrics.early_stop_log(log, patience=2).orderBy("epoch").collect()
    assert [r.best_epoch for r in out] == [0, 1, 1, 1, 1] and [r.stop for r in out] == [False, False, False, True, False]


def test_ranks_and_quantiles_by_ranges(spark):
    import numpy as np

    from cairnwork.functions import ranks

    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 500)] + [("b", float(v)) for v in rng.integers(0, 5, 300)] + [(None, 2.0), (None, 1.0), ("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    found = {r.g: (r.q1, r.q2) for r in ranks.quantiles(df, ["g"], "x", (0.25, 0.9), ("q1", "q2")).collect()}
    assert found.keys() == by.keys()
    for g, values in by.items():
        assert np.allclose(found[g], np.quantile(values, [0.25, 0.9]))
    places = ranks.before(df.where("x IS NOT NULL"), ["g"], "x", "place").collect()
    for g, values in by.items():
        mine = sorted((r.place, r.x) for r in places if r.g == g)
        assert [p for p, _ in mine] == list(range(len(values))) and [x for _, x in mine] == sorted(values)
    alone = ranks.quantiles(df, [], "x", (0.5,), ("q",)).first()
    assert alone.q == np.quantile([x for _, x in rows if x is not None], 0.5)


def test_correlation_of_arrays_with_gaps(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(100, 1, (60, 4))
    x[:, 3] = 5.0
    rows = [(i, [None if (i + k) % 11 == 0 else float(v) for k, v in enumerate(row)]) for i, row in enumerate(x)] + [(99, None)]
    found = {(r.i, r.j): r.r for r in profile.correlation_matrix(spark.createDataFrame(rows, "id int, v array<double>").repartition(3)).collect()}
    for i in range(4):
        for j in range(4):
            both = [(v[i], v[j]) for _, v in rows if v and v[i] is not None and v[j] is not None]
            if 3 in (i, j):
                assert found[i, j] is None or abs(found[i, j]) < 1e-3
            else:
                assert abs(found[i, j] - np.corrcoef(*zip(*both, strict=True))[0, 1]) < 1e-9


def test_composed_models_come_back(spark, tmp_path):
    from cairnwork.operators import models

    rows = [(i, i % 2, [float(i % 2) + 0.1 * (i % 7), float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label int, v array<double>")
    for name, model in (("b", models.BoostedTrees(df, rounds=1, depth=2)), ("k", models.KernelSVM(df, "id", features=8, iterations=2)), ("t", models.TwoStage(df.withColumn("label", F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("label"))), majority=0))):
        models.save(model, f"file://{tmp_path}/{name}")
        back = models.load(f"file://{tmp_path}/{name}")
        assert sorted(map(tuple, model.predict(df, "id").select("id", "pred").collect())) == sorted(map(tuple, back.predict(df, "id").select("id", "pred").collect()))


def adf_by_hand(x):
    """The test with lags by AIC, every regression by least squares."""
    x = np.array(x, float)
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)

    def regress(lags, start):
        y = d[start:]
        z = np.column_stack([x[start:-1], np.ones(len(y)), *[d[start - k : len(d) - k] for k in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        return y, z, beta, ((y - z @ beta) ** 2).sum()

    lags = min(range(most + 1), key=lambda p: (lambda y, z, b, s: len(y) * math.log(s / len(y)) + 2 * z.shape[1])(*regress(p, most)))
    y, z, beta, sse = regress(lags, lags)
    return beta[0] / math.sqrt(np.linalg.inv(z.T @ z)[0, 0] * sse / (len(y) - z.shape[1])), lags, len(y)


@pytest.mark.parametrize("steps", [3, 7, 64, 1 << 16])
def test_adf_with_lags_by_chunks(spark, steps):
    rng = np.random.default_rng(11)
    series = {}
    for s, n in enumerate((30, 61, 100, 150, 240, 7)):
        x = [1000.0, 1001.0, 1000.5]
        while len(x) < n:  # steps that depend on earlier steps, so that lags are chosen
            x.append(x[-1] + 0.6 * (x[-1] - x[-2]) - 0.35 * (x[-2] - x[-3]) - 0.05 * (x[-1] - 1000) + rng.normal())
        series[s] = x[:n]
    series |= {90: [5.0] * 40, 91: [1.0, 2.0], 92: [1.0]}
    df = spark.createDataFrame([(s, t, v) for s, x in series.items() for t, v in enumerate(x)], "series_id long, t long, x double").repartition(3)
    found = {r.series_id: r for r in stattests.adf_aic(df, steps).collect()}
    assert set(found) == set(series) and all(found[s].adf is None and found[s].error for s in (90, 91, 92))
    lags = set()
    for s in range(6):
        adf, lag, n = adf_by_hand(series[s])
        assert found[s].adf == pytest.approx(adf, rel=1e-6) and (found[s].lags, found[s].n_obs) == (lag, n) and found[s].stationary == (found[s].p < 0.05)
        lags.add(lag)
    assert len(lags) > 2
    most = stattests.lag_chunks(df, steps).select(F.max(F.size("x"))).first()[0]
    assert most <= steps + 17  # no chunk holds more than its steps and the lags before them


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_frames_and_chroma_by_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(frames, "CHUNK", chunk)
    rng = np.random.default_rng(14)
    values = {s: rng.normal(size=n).round(3).tolist() for s, n in enumerate((15, 16, 17, 24, 25, 66, 200, 41))} | {90: [0.0] * 30}
    df = spark.createDataFrame([(s, t, v) for s, x in values.items() for t, v in enumerate(x)], "series_id long, t long, x double").repartition(3)
    want = {(s, k): x[8 * k : 8 * k + 16] for s, x in values.items() for k in range(max(0, -(-(len(x) - 16) // 8)))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        f = frames.frame_arrays(df, 16, 8)
        plan = f._jdf.queryExecution().executedPlan().toString()
        found = {(r.series_id, r.frame): r.x for r in f.collect()}
        chroma = {(r.series_id, r.frame): r.chroma for r in spectral.chroma(spectral.power_spectrum(f, 16), 16, 16.0, 1.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == want and "collect_list" not in plan  # a group a frame, sorted by itself
    classes = spectral.pitch_classes(16, 16.0, 1.0)
    for key, x in want.items():
        p = np.abs(np.fft.rfft(np.array(x) * np.array(spectral.hann(16)))) ** 2
        c = np.array([sum(v for v, at in zip(p, classes, strict=True) if at == k) for k in range(12)])
        assert np.allclose(chroma[key], c / c.max() if c.max() > 0 else c)


@pytest.mark.parametrize("chunk", [7, 512])
def test_long_vector_equals_its_operators(spark, monkeypatch, chunk):
    """Series of many chunks and of fewer frames than a derivative looks at; frames are read once, not once a block."""
    from cairnwork.operators import clips
    from cairnwork.plans import series as plans

    monkeypatch.setattr(clips, "CHUNK", chunk)
    rng = np.random.default_rng(15)
    tones = {s: (100 * np.sin(np.arange(n) * (0.9 + 0.1 * s)) + rng.normal(0, 60, n)).round(2).tolist() for s, n in enumerate((17, 25, 81, 88, 97, 130, 300, 900))}
    tones |= {90: [0.0] * 40, 91: [5.0] * 200, 92: [1.0] * 16, 93: rng.normal(size=150).tolist()}
    df = spark.createDataFrame([(s, t, float(v)) for s, x in tones.items() for t, v in enumerate(x)], "series_id long, t long, x double").repartition(3)
    f = frames.frame_arrays(df, 16, 8).persist()
    settings = clips.Settings(16, 16.0, plans.BANK, plans.CEPS, plans.LOW, 2.0, 1.0, plans.LAGS)
    found = {r.series_id: r.vector for r in clips.vectors(f, settings).collect()}
    s = spectral.power_spectrum(f, 16)
    c, q = spectral.cepstrum(spectral.to_db(spectral.mel_bands(s, plans.BANK)), plans.BANDS, plans.CEPS), spectral.log_freq_cepstrum(s, 16, 16.0, plans.LOW)
    blocks = [x for b in (c, q) for x in (b, spectral.delta(b, 1).withColumnRenamed("d", "c"), spectral.delta(b, 2).withColumnRenamed("d", "c"))]
    blocks = [spectral.vector(spectral.pool_two(x, "c"), ["mean", "std"], "v") for x in blocks]
    blocks.append(frames.f0_summary(f, frames.f0_track(f, 16.0, *plans.LAGS)).select("series_id", F.array(*plans.PITCHES).alias("v")))
    blocks += [spectral.vector(spectral.pool_two(x, column), ["mean", "std"], "v") for x, column in ((spectral.contrast(s, 16, 16.0, 2.0), "contrast"), (spectral.chroma(s, 16, 16.0, 1.0), "chroma"))]
    blocks.append(plans.descriptor_means(f).select("series_id", F.array(*plans.MEANS).alias("v")))
    want = {}
    for b in blocks:
        for r in b.collect():
            want.setdefault(r.series_id, []).extend(r.v)
    f.unpersist()
    assert set(found) == set(want) == set(tones) - {92} and len(found[0]) == len(plans.NAMES_411)
    for key in want:
        assert np.allclose(found[key], want[key], rtol=1e-9, atol=1e-7)
    plan = plans.clip_vector_411(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2  # once for values, once for lengths


def grown_by_hand(x, stats, score, allowed, features, depth):
    """A tree as nested tuples, every split tried row by row: (feature, threshold, left, right) or the node's sums."""

    def node(rows, number):
        total = stats[rows].sum(0)
        best = None
        if number.bit_length() <= depth:
            for f in features(number):
                for t in sorted(set(x[rows, f].tolist()))[:-1]:
                    goes = x[rows, f] > t
                    a, b = stats[rows[~goes]].sum(0), stats[rows[goes]].sum(0)
                    gain = round((score(a) + score(b) - score(total)) / max(1.0, abs(score(total))), 10)
                    if allowed(a, b) and gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, t, goes)
        if best is None:
            return total
        _, f, t, goes = best
        return f, t, node(rows[~goes], 2 * number), node(rows[goes], 2 * number + 1), score(stats[rows[~goes]].sum(0)) + score(stats[rows[goes]].sum(0)) - score(total)

    return node(np.arange(len(x)), 1)


def leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def tree_rows(spark):
    rng = np.random.default_rng(12)
    rows = [(k, int(c), [float(v) for v in rng.integers(0, 9, 5) + c * (rng.random(5) < 0.5)]) for k, c in enumerate(rng.integers(0, 3, 90))]
    df = spark.createDataFrame(rows, "key long, label int, v array<double>").repartition(3)
    ids = {r.key: r.id for r in df.select("key", F.xxhash64("key").alias("id")).collect()}
    return df, np.array([ids[k] for k, _, _ in rows]), np.array([c for _, c, _ in rows]), np.array([v for _, _, v in rows])


@pytest.mark.parametrize("local_rows", [0, 20, 4096])
def test_forest_equals_growing_by_hand(spark, local_rows):
    from cairnwork.operators import trees

    df, ids, of, x = tree_rows(spark)
    model = trees.Forest(df, "key", trees=6, depth=5, local_rows=local_rows)
    weights = np.array([len(of) / (3 * (of == c).sum()) for c in range(3)])
    gini = lambda s: (s[:3] ** 2).sum() / max(s[:3].sum(), 1e-300)
    proba, importance = np.zeros((len(x), 3)), []
    for t in range(6):
        times = trees.bootstrap(ids, t, 42)
        used = times > 0
        stats = np.column_stack([np.eye(3)[of] * (times * weights[of])[:, None], np.ones(len(of))])[used]
        some = lambda n: np.sort(np.argsort(trees.uniforms(np.arange(5), 43, t, n), kind="stable")[:2]).tolist()  # noqa: B023, E731
        tree = grown_by_hand(x[used], stats, gini, lambda a, b: a[3] >= 2 and b[3] >= 2, some, 5)
        proba += np.array([(lambda s: s[:3] / s[:3].sum())(leaf(tree, row)) for row in x]) / 6
        gains = np.zeros(5)
        work = [tree]
        while work:
            if isinstance(n := work.pop(), tuple):
                gains[n[0]] += n[4]
                work += n[2:4]
        importance.append(gains / gains.sum())
    found = {r.key: r for r in model.predict(df, "key").collect()}
    assert np.allclose([found[k].proba for k in range(len(x))], proba) and all(found[k].pred == int(np.argmax(np.round(proba[k], 12))) or len(set(np.round(proba[k], 9))) < 3 for k in range(len(x)))
    assert np.allclose(model.importances(), np.mean(importance, 0))
    table = models.feature_importance(model, list("abcde"), spark, 3).collect()
    assert [r.importance for r in table] == sorted(model.importances(), reverse=True)[:3]


@pytest.mark.parametrize("local_rows", [0, 25, 4096])
def test_boosting_equals_growing_by_hand(spark, local_rows, monkeypatch):
    from cairnwork.operators import trees

    monkeypatch.setattr(trees, "CHECKPOINT", 2)
    df, ids, of, x = tree_rows(spark)
    model = trees.BoostedTrees(df, rounds=5, depth=3, key="key", local_rows=local_rows)
    weights = np.array([len(of) / (3 * (of == c).sum()) for c in range(3)])
    scores = np.zeros((len(x), 3))
    for r in range(5):
        used = trees.uniforms(ids, 42, r + 1) < 0.8
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(3):
            stats = np.column_stack([weights[of] * (p[:, k] - (of == k)), weights[of] * p[:, k] * (1 - p[:, k]), np.ones(len(of))])[used]
            some = np.sort(np.argsort(trees.uniforms(np.arange(5), 43, r, k), kind="stable")[:4]).tolist()
            tree = grown_by_hand(x[used], stats, lambda s: s[0] ** 2 / (s[1] + 1), lambda a, b: a[1] >= 1 and b[1] >= 1, lambda n: some, 3)  # noqa: B023
            step[:, k] = [-0.1 * s[0] / (s[1] + 1) for s in (leaf(tree, row) for row in x)]
        scores += step
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    found = {r.key: r for r in model.predict(df, "key").collect()}
    assert np.allclose([found[k].proba for k in range(len(x))], p)


def test_forest_nodes_stay_off_the_driver(spark, monkeypatch):
    import pickle

    from pyspark import RDD

    from cairnwork.operators import trees

    df, *_ = tree_rows(spark)
    sizes, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: (found := collect(self), sizes.append(len(pickle.dumps(found))))[0])
    model = trees.Forest(df, "key", trees=20)
    assert sum(sizes) < 10_000  # 62,724 when trees came whole
    assert abs(model.importances().sum() - 1) < 1e-9 and model.pieces.count() == 20
    left, feature = (np.frombuffer(x, np.int32) for x in model.pieces.select("left", "feature").first())
    assert len(left) > 20 and ((left < 0) == (feature < 0)).all()


def test_boosting_takes_a_job_a_round(spark):
    """Over more rows than a node may have that is finished at once, too; trees grown a level a pass are the same."""
    from cairnwork.operators import trees

    rng = np.random.default_rng(13)
    of = rng.integers(0, 3, 5000)
    df = spark.createDataFrame([(k, int(c), [float(v) for v in rng.normal(c, 2, 4)]) for k, c in enumerate(of)], "key long, label int, v array<double>").repartition(3)
    jobs, found = [], []
    for group, settings in (("one", {"rounds": 1}), ("four", {"rounds": 4}), ("levels", {"rounds": 4, "local_rows": 700})):
        spark.sparkContext.setJobGroup(f"boosting {group}", group)
        model = trees.BoostedTrees(df, depth=4, key="key", **settings)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting {group}")))
        found.append({r.key: r.proba for r in model.predict(df, "key").collect()})
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 3
    assert jobs[2] > jobs[1] + 3 and np.allclose([found[1][k] for k in range(5000)], [found[2][k] for k in range(5000)])


def test_forest_predicts_from_a_table(spark, monkeypatch):
    import pickle

    from cairnwork.operators import trees

    df, *_ = tree_rows(spark)
    model = trees.Forest(df, "key", trees=20, local_rows=30)
    assert len(pickle.dumps({k: v for k, v in vars(model).items() if k != "pieces"})) < 30_000  # 43,268 when it held all nodes
    many = df.union(df.select(F.col("key") + 100, "label", "v")).union(df.select(F.col("key") + 200, "label", "v"))
    found = {r.key: (r.truth, r.proba, r.pred) for r in model.predict(many, "key").collect()}
    monkeypatch.setattr(trees, "ROUTED", 7)
    monkeypatch.setattr(trees, "HELD", 500)  # a block's sums leave in several parts
    parts = {r.key: (r.truth, r.proba, r.pred) for r in model.predict(many.repartition(5), "key").collect()}
    assert len(found) == 270 and found == parts
    assert all(found[k] == found[k + 100] == found[k + 200] for k in range(90))
    none = model.predict(df.where("key < 0"), "key")
    assert none.columns == ["key", "truth", "proba", "pred"] and none.count() == 0


def test_trees_save_and_odd_rows(spark, tmp_path):
    from cairnwork.operators import trees

    df, *_ = tree_rows(spark)
    for name, model in (("f", trees.Forest(df, trees=3, depth=4)), ("b", trees.BoostedTrees(df, rounds=2, depth=2))):
        models.save(model, f"file://{tmp_path}/{name}")
        a, b = (sorted((r.key, r.pred, *r.proba) for r in m.predict(df, "key").collect()) for m in (model, models.load(f"file://{tmp_path}/{name}")))
        assert a == b
    one = spark.createDataFrame([(k, 4, [1.0, 2.0]) for k in range(5)], "key long, label int, v array<double>")
    for model in (trees.Forest(one, trees=2), trees.BoostedTrees(one, rounds=1)):
        assert {(r.pred, tuple(r.proba)) for r in model.predict(one, "key").collect()} == {(4, (1.0,))}


def test_forward_backward_equals_all_paths():
    """Sequences of several lengths side by side against a sum over every path of states."""
    from itertools import product

    rng = np.random.default_rng(5)
    start, mean, var = np.array([0.5, 0.3, 0.2]), np.array([0.0, 1.0, 3.0]), np.array([1.0, 0.5, 2.0])
    move = np.array([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]])
    sequences = [rng.normal(1, 2, n) for n in (1, 2, 3, 4, 5, 5, 2)]
    found_ll, found_moves, found_shares, lls, moves = 0.0, np.zeros((3, 3)), {}, 0.0, np.zeros((3, 3))
    sizes = np.array([len(s) for s in sequences])
    flat, starts = np.concatenate(sequences), np.cumsum(sizes) - sizes
    for x, n in mixtures.side_by_side(flat, starts, sizes, 3):
        ll, shares, m = mixtures.forward_backward(x, n, start, move, mean, var)
        found_ll, found_moves = found_ll + ll.sum(), found_moves + m
        for row, k, s in zip(x, n, shares, strict=True):
            assert np.allclose(s[k:], 0)
            found_shares[tuple(row[:k])] = s[:k]
    assert len(found_shares) == len(sequences)
    for x in sequences:
        emit = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var)
        total, shares, m = 0.0, np.zeros((len(x), 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=len(x)):
            p = start[path[0]] * np.prod([emit[t, s] for t, s in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            total += p
            for t, s in enumerate(path):
                shares[t, s] += p
            for a, b in zip(path, path[1:]):
                m[a, b] += p
        lls, moves = lls + np.log(total), moves + m / total
        assert np.allclose(found_shares[tuple(x)], shares / total)
    assert found_ll == pytest.approx(lls) and np.allclose(found_moves, moves)


def test_hmm_takes_many_sequences_side_by_side(spark, monkeypatch):
    """Ten times as many sequences take at most ten times the time; arrays stay within their bound; null and empty ones count for nothing."""
    import time

    rng = np.random.default_rng(5)
    start, mean, var, move = np.array([0.5, 0.5]), np.array([0.0, 1.0]), np.ones(2), np.full((2, 2), 0.5)
    took = []
    for n in (300, 3000):
        sizes = rng.integers(1, 60, n)
        flat, starts = rng.normal(size=sizes.sum()), np.cumsum(sizes) - sizes
        began = time.time()
        for x, k in mixtures.side_by_side(flat, starts, sizes, 2):
            mixtures.forward_backward(x, k, start, move, mean, var)
        took.append(time.time() - began)
    assert took[1] < 10 * took[0]
    monkeypatch.setattr(mixtures, "BATCH_STATES", 400)
    shapes = [x.shape for x, _ in mixtures.side_by_side(flat, starts, sizes, 2)]
    assert sum(s[0] for s in shapes) == 3000 and all(s[0] == 1 or s[0] * s[1] * 2 <= 400 for s in shapes)
    rows = [(k % 2, [float(v) for v in rng.normal(k % 2, 1, 4 + k % 5)]) for k in range(40)]
    a = mixtures.fit_hmm(spark.createDataFrame(rows, "class int, x array<double>").repartition(3), states=2, rounds=3)
    assert [sorted(h) for h in a[1]] == [[0, 1]] * 3 and all(b[c] >= a_[c] - 1e-6 for a_, b in zip(a[1], a[1][1:]) for c in (0, 1))
    odd = mixtures.fit_hmm(spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (0, [])], "class int, x array<double>"), rounds=2)
    assert np.isfinite(odd[1][-1][0])


def test_long_frames_autocorrelate_by_fft(spark):
    rng = np.random.default_rng(3)
    values = [[float(v) for v in rng.normal(size=n)] for n in (2048, 2048, 100, 7)] + [[float(np.sin(2 * np.pi * t / 50)) for t in range(2048)], [0.0] * 64]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "series_id long, frame long, x array<double>")
    for row in frames.autocorrelated(df, range(1, 2048)).collect():
        x = np.array(values[row.frame])
        want = np.correlate(x, x, "full")[len(x) :]
        assert np.allclose(row.r[: len(want)], want, atol=1e-8) and not any(row.r[len(want) :])
        assert row.r0 == pytest.approx((x * x).sum()) and row.peak == pytest.approx(np.abs(x).max())
    track = {r.frame: r.f0 for r in frames.f0_track(df, 8000.0, 10, 100).collect()}
    assert track[4] == pytest.approx(8000 / 50) and 5 not in track
    few, many = (frames.autocorrelated(df.where("frame < 2"), range(1, 21), limit).orderBy("frame").collect() for limit in (32, 0))
    assert all(np.allclose(a.r, b.r) for a, b in zip(few, many, strict=True))
    peaks = {r.frame: r.peak for r in frames.autocorr_peak(df.where("frame >= 4"), 2048).collect()}
    assert peaks[4] > 0.9 and peaks[5] is None
    quiet = frames.hnr(df.where("frame = 5"), 64).first()
    assert quiet.hnr == 0.0


@pytest.mark.parametrize("chunk, pivots", [(2048, 256), (7, 256), (7, 3), (20, 2)])
def test_nearest_equals_comparing_all(spark, chunk, pivots):
    """Ties, copies, a class of one row, string keys; clusters, so that triangle bounds leave parts out."""
    rng = np.random.default_rng(chunk + pivots)
    points = [("a", [float(x) for x in rng.integers(0, 4, 2) + 50 * rng.integers(0, 3)]) for _ in range(70)]
    points += [("b", [float(x) for x in rng.normal(size=2)]) for _ in range(25)] + [("b", [9.0, 9.0])] * 30 + [("c", [1.0, 2.0])] + [("d", [1.0, 2.0]), ("d", [1.0, 5.0])]
    rows = [(f"k{i:03d}", c, v) for i, (c, v) in enumerate(points)]
    df = spark.createDataFrame([*rows, ("none", "a", None)], "key string, label string, v array<double>").repartition(3)
    found = {}
    for r in rebalance.nearest(df, "key", "v", "label", 3, chunk, pivots).collect():
        found.setdefault(r.key, []).append((r.r, r.d2, r.neighbour))
    for key, c, v in rows:
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, d, w in rows if d == c and k != key)[:3]
        got = [(d2, n) for _, d2, n in sorted(found.get(key, []))]
        assert [n for _, n in got] == [n for _, n in want] and np.allclose([d for d, _ in got], [d for d, _ in want])


def test_far_parts_arent_compared():
    from cairnwork.operators import neighbours

    between = np.array([[0.0, 100.0], [100.0, 0.0]])
    bound = neighbours.reach([[0.0, 1.0, 1.5, 2.0], [0.0, 0.5, 0.5, 0.7]], np.array([2.0, 0.7]), between, 3)
    assert bound.tolist() == [4.0, pytest.approx(1.4)]
    assert np.isinf(neighbours.reach([[0.0, 1.0]], np.array([1.0]), np.zeros((1, 1)), 3)).all()


def test_ranges_split_until_they_are_small(spark, monkeypatch):
    """A group of many values goes by ranges of ranges, a group of one value by one; bounds of windows hold."""
    from cairnwork.functions import ranks

    monkeypatch.setattr(ranks, "RANGES", 4)
    monkeypatch.setattr(ranks, "MOST_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.exponential(1, 700)] + [("b", 1.0)] * 90 + [("c", float(v)) for v in range(10)] + [("d", None)] + [(None, float(v)) for v in rng.integers(0, 100, 150)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    ranged = ranks._ranged(df, ["g"], "x").where("x IS NOT NULL")
    for r in ranged.groupBy("g", "__range").agg(F.count("*").alias("n"), F.countDistinct("x").alias("values")).collect():
        assert r.n <= 20 or r["values"] == 1
    assert ranged.where("g = 'a'").select(F.max(F.size("__range"))).first()[0] > 2
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    found = {r.g: r.q for r in ranks.quantiles(df, ["g"], "x", (0.37,), ("q",)).collect()}
    places = ranks.before(df.where("x IS NOT NULL"), ["g"], "x", "place").collect()
    for g, values in by.items():
        assert found[g] == pytest.approx(np.quantile(values, 0.37))
        mine = sorted((r.place, r.x) for r in places if r.g == g)
        assert [p for p, _ in mine] == list(range(len(values))) and [x for _, x in mine] == sorted(values)


@pytest.mark.parametrize("block", [3, 4096])
def test_normal_scores_over_copies(spark, block):
    """A value in nine tenths of a group's rows, against ranks one by one; a group without spread has no result."""
    from statistics import NormalDist

    rng = np.random.default_rng(2)
    groups = {0: [5.0] * 90 + [float(v) for v in rng.normal(5, 1, 10)], 1: [float(v) for v in rng.normal(size=40)], 2: [1.0] * 12}
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [(1, None)], "g int, x double").repartition(3)
    found = {r.g: r for r in stattests.shapiro_francia(df, ["g"], "x", block).collect()}
    for g in (0, 1):
        x, n = np.sort(groups[g]), len(groups[g])
        m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        assert found[g].w == pytest.approx(np.corrcoef(x, m)[0, 1] ** 2, abs=1e-7)
    assert found[2].w is None and not found[0].w_normal
    assert stattests.shapiro_francia(df.where("g = 1"), [], "x", block).first().w == pytest.approx(found[1].w)


@pytest.mark.parametrize("size", [3, 5, 1 << 16])
def test_transforms_by_chunks(spark, size):
    rng = np.random.default_rng(4)
    x = {s: rng.normal(size=n) for s, n in enumerate((17, 1, 6))}
    df = spark.createDataFrame([(s, t, float(v)) for s, values in x.items() for t, v in enumerate(values)], "series_id long, t long, x double").repartition(3)
    moved = transforms.shifted(df, {"later": 4, "earlier": -2}, size).collect()
    assert len(moved) == 24
    for r in moved:
        v = x[r.series_id]
        assert r.later == (v[r.t - 4] if r.t >= 4 else 0.0) and r.earlier == (v[r.t + 2] if r.t + 2 < len(v) else 0.0)
    for r in transforms.fir_convolve(df, [1.0, 0.5, 0.25], 0.4, size).collect():
        v = x[r.series_id]
        assert r.x == pytest.approx(0.6 * v[r.t] + 0.4 * np.convolve(v, [1.0, 0.5, 0.25])[r.t])
    for r in transforms.compose(df, ["shift_right", "flip", "shift_left"], size).collect():
        v = x[r.series_id]
        assert r.x == (-v[r.t] if r.t + 4 < len(v) else 0.0)


def test_halfway_values_round_away_from_zero_in_any_order(spark):
    """Kurtosis -0.7325, -0.7325 and -0.5625 exactly; sums in other orders end a bit above or below."""
    from cairnwork.plans import series

    rng = np.random.default_rng(11)
    want, rows = {}, []
    for values, kurtosis in (([4, 3, 4, 2, 5, 3, 3], -0.733), ([6, 4, 5, 4, 3, 5, 4], -0.733), ([3, 1, 1, 1, 6, 3, 1, 4], -0.563)):
        for _ in range(20):
            want[len(want)] = kurtosis
            rows += [(len(want) - 1, k, [float(x)]) for k, x in enumerate(rng.permutation(values))]
    pooled = spectral.pool_six(spark.createDataFrame(rows, "series_id long, frame long, c array<double>"), "c")
    whole = spectral.vector(pooled, series.SIX, "v", stat_major=False).select("series_id", series.settled(F.col("v")).alias("vector"))
    found = series.laid_out(whole, series.SIX, 3).where("name = 'kurtosis'").collect()
    assert {r.series_id: r.value for r in found} == want
