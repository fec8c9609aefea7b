"""Running experiments: gates before evaluation, diagnostics, prediction, latency, provenance, persistence."""

from __future__ import annotations

import hashlib
import json
import statistics
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlloom.functions.features import resolve, with_features
from urlloom.functions.seeds import derive_seed
from urlloom.functions.urls import with_clean_urls
from urlloom.operators import prepare
from urlloom.operators.modelling import Fitted
from urlloom.operators.split import confusion, ranking_metrics, training_fraction


def evaluate(train: DataFrame, test: DataFrame, names: list[str], family: str, p: dict, seed: int) -> dict:
    """Metrics of one fit on one test table."""
    scored = Fitted(train.select("label", *names), names, family, p, seed).score(test.select("label", *names)).withColumn("k", F.lit(0)).persist()
    row = confusion(scored, ["k"]).join(ranking_metrics(scored, ["k"]), "k").drop("k").first().asDict()
    scored.unpersist()
    return row


#: The purposes that seeds of diagnostics are derived for.
_SIZE_PURPOSE = "assignment03:size:{}:{:.4f}"
_MODEL_PURPOSE = "model_sensitivity:{}"


def training_size_curve(df: DataFrame, names: list[str], family: str, p: dict, fractions: list[float], master: int, dev_seed: int = 0) -> list[dict]:
    """Validation metrics after training on growing subsets of the train groups of the split made with ``dev_seed``."""
    validation, out = df.filter("split = 'validation'"), []
    for f in fractions:
        part = df.filter("split = 'train'") if f >= 1 else training_fraction(df, f, derive_seed(master, _SIZE_PURPOSE.format(dev_seed, f))).filter("split = 'train'")
        out.append({"fraction": f, "rows": part.count()} | evaluate(part, validation, names, family, p, derive_seed(master, "model")))
    return out


def domain_overlap(df: DataFrame, group: str = "domain_group") -> DataFrame:
    """Groups of the test split that train has too: 0 for group-disjoint splits."""
    test = df.filter("split = 'test'").select(group).distinct()
    shared = test.join(df.filter("split = 'train'").select(group).distinct(), group, "left_semi")
    return test.agg(F.count(F.lit(1)).alias("test_groups")).join(F.broadcast(shared.agg(F.count(F.lit(1)).alias("shared_groups"))))


def seed_sensitivity(train: DataFrame, test: DataFrame, names: list[str], family: str, p: dict, master: int, n: int = 5) -> list[dict]:
    seeds = [derive_seed(master, _MODEL_PURPOSE.format(i)) for i in range(n)]
    return [{"seed": s} | evaluate(train, test, names, family, p, s) for s in seeds]


def freeze(rows: DataFrame, target: int, seed: int, gate_passed: bool, config: dict, audited_config_sha256: str) -> tuple[DataFrame, dict]:
    """The selected rows of a pool, if its gate has passed, its configuration is the audited one and nothing falls short.

    The draw is made twice, the second time from dealt-out rows, and must be the same.
    """
    if not gate_passed:
        raise ValueError("the audit gate has not passed")
    if config_sha256(config) != audited_config_sha256:
        raise ValueError("the configuration differs from the audited one")
    first = prepare.balance(prepare.dispositions(rows), target, seed).filter("selected").select("url_clean", "label")
    second = prepare.balance(prepare.dispositions(rows.repartition(7)), target, seed).filter("selected").select("url_clean", "label")
    if first.exceptAll(second).head(1) or second.exceptAll(first).head(1):
        raise ValueError("the selection depends on the order of rows")
    made = prepare.balance(prepare.dispositions(rows), target, seed)
    manifest = prepare.sampling_manifest(made, target, seed)
    if manifest["shortfall"]:
        raise ValueError("fewer rows than the target")
    return made.filter("selected"), manifest


def config_sha256(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def require_frozen(protocol: dict, frozen: dict, files: dict[str, str]) -> None:
    """Before a final evaluation: the protocol and the hashes of replayed files equal the frozen ones."""
    if protocol != frozen["protocol"]:
        raise ValueError("the protocol differs from the frozen development run")
    changed = sorted(n for n, h in frozen["files"].items() if files.get(n) != h)
    if changed:
        raise ValueError(f"replayed files differ: {', '.join(changed)}")


def predict_json(urls: DataFrame, fitted: Fitted, url: str = "url") -> DataFrame:
    """One JSON line a URL: url, url_clean, probability and prediction, or the reason of a rejection."""
    names = resolve(fitted.names)
    rows = with_features(with_clean_urls(urls.select(F.col(url).alias("url_raw"))), names)
    good = fitted.score(rows.filter("reason IS NULL").select("url_raw", "url_clean", *names))
    line = F.to_json(F.struct(F.col("url_raw").alias("url"), "url_clean", F.col("score").alias("probability"), (F.col("score") >= 0.5).cast("int").alias("prediction")))
    bad = rows.filter("reason IS NOT NULL").select(F.to_json(F.struct(F.col("url_raw").alias("url"), F.col("reason").alias("error"))).alias("line"))
    return good.select(line.alias("line")).unionByName(bad)


def latency(run, batches: list[DataFrame], warm_up: int = 3, repetitions: int = 30) -> list[dict]:
    """Median and 95th percentile of milliseconds a URL of ``run`` over each batch."""
    out = []
    for b in batches:
        n, took = b.count(), []
        for i in range(warm_up + repetitions):
            began = time.perf_counter()
            run(b).write.format("noop").mode("overwrite").save()
            took += [(time.perf_counter() - began) * 1000 / n] if i >= warm_up else []
        out.append({"batch_size": n, "repetitions": repetitions, "median_ms_per_url": statistics.median(took), "p95_ms_per_url": float(np.percentile(took, 95))})
    return out


def provenance(paths: list[str]) -> dict:
    """Versions, the state of the repository and the hashes of code and rule files."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    files = {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths}
    return {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "commit": git("rev-parse", "HEAD"), "changed": bool(git("status", "--porcelain")), "files": files}


def save(fitted: Fitted, folder: str, feature_set: str, config: dict) -> None:
    """The classifier in Spark's format and a JSON sidecar with everything else; refuses to overwrite."""
    sidecar = {"feature_names": fitted.names, "feature_set": feature_set, "family": fitted.family, "threshold": 0.5, "config": config, "medians": fitted.imputer.medians, "gaps": fitted.imputer.gaps, "scale": fitted.scaler and fitted.scaler.stats}
    fitted.model.write().save(f"{folder}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(sidecar, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/sidecar")


def load(spark: SparkSession, folder: str) -> Fitted:
    """What ``save`` wrote, ready to score."""
    from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel

    from urlloom.operators.modelling import Imputer, Scaler

    side = json.loads(spark.read.text(f"{folder}/sidecar").first()[0])
    kinds = {"logistic_regression": LogisticRegressionModel, "decision_tree": DecisionTreeClassificationModel, "random_forest": RandomForestClassificationModel, "gradient_boosting": GBTClassificationModel}
    imputer = Imputer.__new__(Imputer)
    imputer.names, imputer.medians, imputer.gaps = side["feature_names"], side["medians"], side["gaps"]
    imputer.outputs = [*imputer.names, *[f"{n}_missing" for n in imputer.gaps]]
    out = Fitted.__new__(Fitted)
    out.names, out.family, out.imputer, out.scaler = side["feature_names"], side["family"], imputer, None
    if side["scale"]:
        out.scaler = Scaler.__new__(Scaler)
        out.scaler.names, out.scaler.stats = imputer.outputs, {n: tuple(v) for n, v in side["scale"].items()}
    out.model = kinds[side["family"]].load(f"{folder}/model")
    return out
