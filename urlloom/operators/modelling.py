"""Preparation of matrices, the four classifier families, grid search and importances."""

from __future__ import annotations

import itertools
import json

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlloom.operators.split import confusion

#: The grids of the four families.
GRIDS = {
    "logistic_regression": {"C": [0.1, 1.0, 10.0]},
    "decision_tree": {"max_depth": [3, 5, 8, None], "min_samples_leaf": [2, 10]},
    "random_forest": {"max_depth": [12, None], "n_estimators": [100]},
    "gradient_boosting": {"learning_rate": [0.05, 0.1], "n_estimators": [100], "max_depth": [3]},
}


class Imputer:
    """Medians of the training rows; an indicator for each feature that training rows lack; all-missing counts as 0."""

    def __init__(self, train: DataFrame, names: list[str]):
        row = train.agg(*[F.median(n).alias(n) for n in names], *[F.count_if(F.col(n).isNull()).alias(f"{n}_gaps") for n in names]).first()
        self.names, self.medians = names, {n: float(row[n]) if row[n] is not None else 0.0 for n in names}
        self.gaps = [n for n in names if row[f"{n}_gaps"]]
        self.outputs = [*names, *[f"{n}_missing" for n in self.gaps]]

    def transform(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.names]
        return df.select(
            *rest, *[F.coalesce(F.col(n).cast("double"), F.lit(self.medians[n])).alias(n) for n in self.names], *[F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in self.gaps]
        )


class Scaler:
    """Mean 0 and population deviation 1; constant features keep their scale."""

    def __init__(self, train: DataFrame, names: list[str]):
        row = train.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
        self.names = names
        self.stats = {n: (row[f"m_{n}"] or 0.0, row[f"s_{n}"] or 1.0) for n in names}

    def transform(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.names]
        return df.select(*rest, *[((F.col(n) - self.stats[n][0]) / self.stats[n][1]).alias(n) for n in self.names])


def parameters(family: str, grid: dict | None = None) -> list[dict]:
    g = (grid or GRIDS)[family]
    return [dict(zip(g, values, strict=True)) for values in itertools.product(*g.values())]


def estimator(family: str, p: dict, n_train: int, seed: int):
    common = {"featuresCol": "features", "labelCol": "label"}
    depth = 30 if p.get("max_depth") is None else p["max_depth"]
    if family == "logistic_regression":
        return LogisticRegression(**common, regParam=1.0 / (p["C"] * n_train), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10)
    if family == "decision_tree":
        return DecisionTreeClassifier(**common, maxDepth=depth, minInstancesPerNode=p["min_samples_leaf"], maxBins=256, seed=seed)
    if family == "random_forest":
        return RandomForestClassifier(**common, maxDepth=depth, numTrees=p["n_estimators"], featureSubsetStrategy="sqrt", seed=seed)
    if family == "gradient_boosting":
        return GBTClassifier(**common, maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=seed)
    raise ValueError(f"unknown family {family}")


class Fitted:
    """A trained pipeline: impute, scale (logistic regression only), classify."""

    def __init__(self, train: DataFrame, names: list[str], family: str, p: dict, seed: int):
        self.names, self.family = names, family
        self.imputer = Imputer(train, names)
        filled = self.imputer.transform(train)
        self.scaler = Scaler(filled, self.imputer.outputs) if family == "logistic_regression" else None
        ready = self._matrix(filled).select("features", F.col("label").cast("double").alias("label")).persist()
        self.model = estimator(family, p, ready.count(), seed).fit(ready)
        ready.unpersist()
        if family == "logistic_regression" and self.model.summary.totalIterations >= 2000:
            raise RuntimeError("logistic regression did not converge")

    def _matrix(self, filled: DataFrame) -> DataFrame:
        if self.scaler:
            filled = self.scaler.transform(filled)
        return VectorAssembler(inputCols=self.imputer.outputs, outputCol="features", handleInvalid="keep").transform(filled)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` without its features, with ``score``."""
        rest = [c for c in df.columns if c not in self.names]
        return self.model.transform(self._matrix(self.imputer.transform(df))).select(*rest, vector_to_array("probability")[1].alias("score"))

    def importances(self) -> list[tuple[str, float]]:
        values = self.model.coefficients if self.family == "logistic_regression" else self.model.featureImportances
        return [(n, float(v)) for n, v in zip(self.imputer.outputs, values.toArray(), strict=True)]


def grid_search(splits: dict[int, DataFrame], sets: dict[str, list[str]], families: list[str], grid: dict | None = None, model_seed: int = 0) -> list[dict]:
    """Validation metrics of every set, family, parameter choice and split seed.

    ``splits``: seed -> table with split, label and features. Given splits are what is compared, so this is a plain loop.
    """
    out = []
    for seed, df in splits.items():
        df = df.persist()
        train, validation = df.filter("split = 'train'"), df.filter("split = 'validation'")
        for (set_name, names), family in itertools.product(sets.items(), families):
            for p in parameters(family, grid):
                scored = Fitted(train.select("label", *names), names, family, p, model_seed).score(validation.select("label", *names))
                m = confusion(scored.withColumn("k", F.lit(0)), ["k"]).drop("k").first().asDict()
                out.append({"feature_set": set_name, "model": family, "parameters": json.dumps(p, sort_keys=True), "seed": seed} | m)
        df.unpersist()
    return out


def select_best(metrics: DataFrame) -> DataFrame:
    """By set and model the parameters with the best mean F1; ties go to the greatest parameter text. Undefined counts as worst."""
    mean = metrics.groupBy("feature_set", "model", "parameters").agg(F.avg(F.coalesce("f1", F.lit(float("-inf")))).alias("mean_f1"))
    return mean.groupBy("feature_set", "model").agg(F.max_by("parameters", F.struct("mean_f1", "parameters")).alias("parameters"), F.max("mean_f1").alias("mean_f1"))


def paired_difference(metrics: DataFrame, base: str = "logistic_regression") -> DataFrame:
    """(feature_set, seed, model, difference): F1 minus that of the base model."""
    b = metrics.filter(F.col("model") == base).select("feature_set", "seed", F.col("f1").alias("base_f1"))
    return metrics.filter(F.col("model") != base).join(b, ["feature_set", "seed"]).select("feature_set", "seed", "model", (F.col("f1") - F.col("base_f1")).alias("difference"))


def permutation_importance(fitted: Fitted, df: DataFrame, ident: str, repeats: int = 10, seed: int = 0, bucket_rows: int = 100_000) -> DataFrame:
    """(feature, importance, std): mean and population deviation of the F1 lost when a feature's values are dealt anew.

    All features and repeats are scored in one pass: each row comes once for each, with that feature's
    value taken from the row at the same place in a hashed order. Beyond ``bucket_rows`` rows, values change places within
    buckets of about that size, which a hash deals anew each time, so no task orders the whole table.
    """
    base = confusion(fitted.score(df.withColumn("k", F.lit(0))), ["k"]).first()["f1"] or 0.0
    buckets = max(1, -(-df.count() // bucket_rows))
    parts = None
    for name, r in itertools.product(fitted.names, range(repeats)):
        mark = lambda kind, name=name, r=r: F.xxhash64(F.lit(f"{seed}:{kind}:{name}:{r}"), F.col(ident))
        dealt = df.withColumn("_b", F.pmod(mark("bucket"), F.lit(buckets)))
        at = lambda *order: F.row_number().over(Window.partitionBy("_b").orderBy(*order)).alias("_at")
        other = dealt.select("_b", at(mark("order"), ident), F.col(name).alias("_v"))
        one = dealt.select("*", at(ident)).join(other, ["_b", "_at"]).withColumn(name, F.col("_v")).drop("_v", "_at", "_b").withColumn("feature", F.lit(name)).withColumn("repeat", F.lit(r))
        parts = one if parts is None else parts.unionByName(one)
    lost = confusion(fitted.score(parts), ["feature", "repeat"]).withColumn("lost", base - F.coalesce("f1", F.lit(0.0)))
    return lost.groupBy("feature").agg(F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("std"))


def predictions(scored: DataFrame, feature_set: str, model: str) -> DataFrame:
    return scored.select("sample_id", "domain_group", "label", "source", F.col("score").alias("prediction_probability"), (F.col("score") >= 0.5).cast("int").alias("prediction"), F.lit(feature_set).alias("feature_set"), F.lit(model).alias("model"))
