"""Classifiers on Spark ML, and what the reference workflow does around them.

A frame of rows has key, label (0..K-1) and v (array of doubles). Predictions are (key, truth, proba, pred).
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions import arrays as A
from cairnwork.functions.hashing import hashed_rank, order_key
from cairnwork.functions.batches import matrix
from cairnwork.operators import machines, metrics, rebalance, scaling, splits
from cairnwork.operators.trees import PIECES, BoostedTrees, Forest
from cairnwork.sources.shipping import ship


def vectors(df: DataFrame, weights: bool = False) -> DataFrame:
    """df with features (vector), label (double) and, on request, weight: rows / (classes * rows of the class)."""
    out = df.withColumn("features", array_to_vector("v")).withColumn("label", F.col("label").cast("double"))
    if weights:
        out = out.join(F.broadcast(rebalance.class_weights(out, "label").select("label", "weight")), "label")  # a row a class
    return out


def scored(model, df: DataFrame, key: str, column: str = "probability") -> DataFrame:
    found = model.transform(vectors(df))
    return found.select(key, F.col("label").cast("int").alias("truth"), vector_to_array(column).alias("proba"), F.col("prediction").cast("int").alias("pred"))


def random_forest(train: DataFrame, trees: int = 500, depth: int = 30, seed: int = 42):
    """Square root of features a split, two rows a leaf at least, classes weighted evenly."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed).fit(vectors(train, True))


class KernelSVM:
    """Radial kernel by random Fourier features, linear machines per pair of classes, votes.

    gamma 'scale' is 1 / (features * variance); SMOTE and scaling see train rows alone. All machines are fitted in the same
    passes (operators.machines). Probabilities come from a logistic regression on the margins.
    """

    def __init__(self, train: DataFrame, key: str, c: float = 10.0, features: int = 64, smote: bool = True, iterations: int = 30, seed: int = 42, gamma: float | str = "scale") -> None:
        self.scaler = scaling.fit_scaler(train)
        rows = scaling.standardize(train, self.scaler)
        if smote:
            made = rebalance.smote(rows, key, "v", "label", seed=seed)
            rows = rows.select("label", "v").unionByName(made.select("label", F.col("synthetic").alias("v")))
        dims = train.select(F.size("v")).first()[0]
        self.gamma = kernel_width(gamma, dims)
        rows = rows.select(F.lit(0).alias("group"), F.col("label").cast("int").alias("label"), "v").persist()
        classes = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]  # the class domain
        self._take(machines.fit(rows, [machines.Setting(0, c, self.gamma)], dims, classes, features, iterations, seed))
        self.calibration = LogisticRegression(featuresCol="margins", maxIter=iterations, regParam=1e-3).fit(self._margins(rows))
        rows.unpersist()

    def _take(self, fitted: machines.Machines) -> None:
        self.fitted, self.classes, self.pairs = fitted, fitted.classes, fitted.pairs

    def parts(self) -> tuple[dict, dict]:
        f = self.fitted
        return {"calibration": self.calibration}, {"scaler": self.scaler, "gamma": self.gamma, "c": f.settings[0].c, "classes": self.classes, "frequencies": f.frequencies.tolist(), "phases": f.phases.tolist(), "weights": f.weights.tolist()}

    def restore(self, parts: dict, values: dict) -> None:
        import numpy as np

        self.scaler, self.gamma, self.calibration = values["scaler"], values["gamma"], parts["calibration"]
        self._take(machines.Machines(np.array(values["frequencies"]), np.array(values["phases"]), values["classes"], [machines.Setting(0, values["c"], self.gamma)], np.array(values["weights"])))

    def _margins(self, scaled: DataFrame) -> DataFrame:
        """scaled with margins (vector) and votes (array), label as a double."""
        fitted, names = self.fitted, scaled.columns

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                v = matrix(batch.column("v"))
                if len(v):
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(fitted.margins(v, 0))), pa.array(list(fitted.votes(v, 0)))], names=[*names, "margins", "votes"])

        ship(scaled.sparkSession)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema)
        return scaled.mapInArrow(run, f"{kinds}, margins array<double>, votes array<double>").withColumn("margins", array_to_vector("margins")).withColumn("label", F.col("label").cast("double"))

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        rows = self._margins(scaling.standardize(df.select(key, "label", "v"), self.scaler))
        out = self.calibration.setProbabilityCol("platt").setPredictionCol("p").setRawPredictionCol("r").transform(rows)
        pick = F.get(F.array(*map(F.lit, self.classes)), A.argmax(F.col("votes")))
        return out.select(key, F.col("label").cast("int").alias("truth"), vector_to_array("platt").alias("proba"), pick.cast("int").alias("pred"))


def kernel_width(gamma: float | str, dims: int) -> float:
    return 1.0 / dims if gamma == "scale" else float(gamma)  # scaled features have variance 1


def mlp(train: DataFrame, hidden: tuple[int, ...] = (64, 64), iterations: int = 100, seed: int = 42):
    dims = train.select(F.size("v")).first()[0]
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    return MultilayerPerceptronClassifier(layers=[dims, *hidden, classes], maxIter=iterations, seed=seed).fit(vectors(train))


def logistic(train: DataFrame, iterations: int = 100, reg: float = 0.0, weights: bool = True):
    return LogisticRegression(family="multinomial", maxIter=iterations, regParam=reg, **({"weightCol": "weight"} if weights else {})).fit(vectors(train, weights))


def soft_label_fit(rows: DataFrame, teacher: DataFrame, key: str, iterations: int = 50):
    """A student fitted to a teacher's probabilities: a row per class, weighted by its probability."""
    soft = rows.drop("label").join(teacher.select(key, F.posexplode("proba").alias("label", "weight")), key).where("weight > 1e-6")
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=iterations).fit(soft.withColumn("features", array_to_vector("v")).withColumn("label", F.col("label").cast("double")))


class TwoStage:
    """Majority class against the rest, then the rest among themselves; the second is heard if P(rest) > threshold."""

    def __init__(self, train: DataFrame, majority: int, threshold: float = 0.3) -> None:
        self.majority, self.threshold = majority, threshold
        self.first = logistic(train.withColumn("label", (F.col("label") != majority).cast("int")))
        self.second = logistic(train.where(F.col("label") != majority))

    def parts(self) -> tuple[dict, dict]:
        return {"first": self.first, "second": self.second}, {"majority": self.majority, "threshold": self.threshold}

    def restore(self, parts: dict, values: dict) -> None:
        self.first, self.second, self.majority, self.threshold = parts["first"], parts["second"], values["majority"], values["threshold"]

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        a = scored(self.first, df, key).select(key, F.get("proba", F.lit(1)).alias("p_rest"))
        b = scored(self.second, df, key).select(key, "truth", F.col("pred").alias("fine"))
        return a.join(b, key).select(key, "truth", "p_rest", decide(F.col("p_rest"), F.col("fine"), self.majority, self.threshold).alias("pred"))


def decide(p_rest, fine, majority: int, threshold: float = 0.3):
    return F.when(p_rest > threshold, fine).otherwise(F.lit(majority))


def project_2d(df: DataFrame, key: str) -> DataFrame:
    """key, label, x, y: the first two principal components of the scaled features."""
    rows = vectors(scaling.standardize(df, scaling.fit_scaler(df)))
    flat = vector_to_array("pc")
    return PCA(k=2, inputCol="features", outputCol="pc").fit(rows).transform(rows).select(key, F.col("label").cast("int").alias("label"), flat[0].alias("x"), flat[1].alias("y"))


def scored_grid(df: DataFrame, names: list[str], grid: list[tuple]) -> DataFrame:
    """place, parameters as columns, fold, macro_f1 of predictions (place, fold, truth, pred); grid: the parameters of each place."""
    kinds = ["string" if any(isinstance(row[k], str) for row in grid) else "double" for k in range(len(names))]
    typed = [(place, *(str(v) if kind == "string" else float(v) for v, kind in zip(row, kinds, strict=True))) for place, row in enumerate(grid)]
    places = df.sparkSession.createDataFrame(typed, f"place int, {', '.join(f'`{n}` {k}' for n, k in zip(names, kinds, strict=True))}")
    f1 = metrics.accuracy_f1(df, ["place", "fold"]).select("place", F.col("fold").cast("int").alias("fold"), "macro_f1")
    return places.join(f1, "place").select("place", *names, "fold", "macro_f1")


def grid_search_cv(df: DataFrame, key: str, grid: dict[str, list], folds: int = 3, seed: int = 42, features: int = 64, iterations: int = 30) -> DataFrame:
    """place, c, gamma, fold, macro_f1 of kernel machines over a grid of C and gamma: all folds and parameters are fitted in the same passes.

    Scaling and SMOTE see a fold's train rows alone. What grows with folds x parameters is the weights, which the driver
    holds, not the number of Spark jobs.
    """
    dealt = splits.stratified_kfold(df.select(key, "label", "v"), "label", key, folds, seed).persist()
    dims = dealt.select(F.size("v")).first()[0]
    group = F.explode(F.array(*[F.lit(g) for g in range(folds)]))  # a copy for each fold: group g is trained on the others
    copies = dealt.select("*", group.alias("group"))
    train = copies.where(F.col("fold") != F.col("group"))
    stats = train.select("group", F.posexplode("v").alias("k", "x")).groupBy("group", "k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scaler = stats.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("k", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("scaler"))

    def scaled(rows: DataFrame) -> DataFrame:  # a row a fold
        return rows.join(F.broadcast(scaler), "group").withColumn("v", F.zip_with("v", "scaler", lambda x, s: (x - s["m"]) / s["s"])).drop("scaler")

    own = scaled(train).withColumn("class", F.concat_ws("|", "group", "label")).persist()
    made = rebalance.smote(own, key, "v", "class", seed=seed, within="group")
    part = F.split("class", r"\|")
    rows = own.select("group", F.col("label").cast("int").alias("label"), "v").unionByName(made.select(part[0].cast("int").alias("group"), part[1].cast("int").alias("label"), F.col("synthetic").alias("v"))).persist()
    classes = [r[0] for r in dealt.select(F.col("label").cast("int")).distinct().orderBy("label").collect()]  # the class domain
    names, places = list(grid), list(product(*grid.values()))
    settings = [(place, g, machines.Setting(g, float(values["c"]), kernel_width(values["gamma"], dims))) for place, values in enumerate(dict(zip(names, p, strict=True)) for p in places) for g in range(folds)]
    fitted = machines.fit(rows, [s for _, _, s in settings], dims, classes, features, iterations, seed)
    rows.unpersist()
    test = scaled(copies.where(F.col("fold") == F.col("group"))).select(key, "group", F.col("label").cast("int").alias("label"), "v")
    which = df.sparkSession.createDataFrame([(k, place, g) for k, (place, g, _) in enumerate(settings)], "setting int, place int, fold int")
    predictions = machines.predict(test, key, fitted).join(F.broadcast(which), "setting")  # a row a setting
    return scored_grid(predictions, names, places)


def best_parameters(scores: DataFrame, names: list[str]) -> DataFrame:
    mean = scores.groupBy("place", *names).agg(F.avg("macro_f1").alias("macro_f1"))
    return mean.orderBy(F.col("macro_f1").desc(), "place").limit(1)


def feature_importance(model, names: list[str], spark, k: int = 20) -> DataFrame:
    """feature, importance, descending, of a Forest or a Spark ML model; importances are as many as features."""
    values = model.importances() if isinstance(model, Forest) else model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(k)


def permuted(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """rows with position k (from 0) of v taken from another row, by two seeded orders."""
    left = hashed_rank(rows, [], order_key(seed, key), "place")
    right = hashed_rank(rows.select(F.col(key).alias("__other"), F.get("v", F.lit(k)).alias("__x")), [], order_key(seed + 1 + k, "__other"), "place")
    moved = F.transform("v", lambda x, i: F.when(i == k, F.col("__x")).otherwise(x))
    return left.join(right, "place").withColumn("v", moved).select(rows.columns)


def _write(spark, path: str, values: dict) -> None:
    """Parameters of a model, which the driver holds anyway, as one row of JSON."""
    spark.createDataFrame([(json.dumps(values),)], "values string").coalesce(1).write.mode("overwrite").parquet(path)


def save(model, path: str) -> None:
    """A fitted model: a Spark ML one, BoostedTrees, Forest, KernelSVM or TwoStage (their own stages and what else they know)."""
    if isinstance(model, PARTS):
        spark = SparkSession.getActiveSession()
        parts, values = model.parts()
        for name, part in parts.items():
            PipelineModel([part]).write().overwrite().save(f"{path}/{name}")
        scaler = values.pop("scaler", None)
        if scaler is not None:
            scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
        if "pieces" in values:
            values.pop("pieces").write.mode("overwrite").parquet(f"{path}/pieces")
        _write(spark, f"{path}/values", {"kind": type(model).__name__, "parts": sorted(parts), "scaled": scaler is not None, **values})
    else:
        PipelineModel([model]).write().overwrite().save(path)


def load(path: str):
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/values")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return PipelineModel.load(path).stages[0]
    values = json.loads(spark.read.parquet(f"{path}/values").first()["values"])
    name = values.pop("kind")
    kind = next(k for k in PARTS if k.__name__ == name)
    parts = {name: PipelineModel.load(f"{path}/{name}").stages[0] for name in values.pop("parts")}
    if values.pop("scaled"):
        rows = spark.read.parquet(f"{path}/scaler")
        values["scaler"] = spark.createDataFrame(rows.collect(), rows.schema)  # a row
    if kind is Forest:
        values["pieces"] = spark.read.schema(PIECES).parquet(f"{path}/pieces")
    model = kind.__new__(kind)
    model.restore(parts, values)
    return model


PARTS = (BoostedTrees, Forest, KernelSVM, TwoStage)
