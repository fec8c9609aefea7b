"""Group-disjoint splits, their checks, and tie-aware metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlloom.functions.seeds import unit
from urlloom.operators.draws import DIGITS, take_smallest

TRIALS = 500
TEST, VALIDATION = 0.15, 0.15 / 0.85


def group_stats(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("size"), F.sum(label).alias("positives"))


def choose_groups(df: DataFrame, fraction: float, seed: int, *, group: str = "domain_group", label: str = "label", trials: int = TRIALS) -> list[str]:
    """Parity mode: draws orders of the sorted group names with numpy's generator.

    A draw stands for its shortest prefix that holds the fraction of all rows; its distance is how far
    the prefix is from the fraction plus how far its rate of positives is from that of all
    rows. The first draw with the least distance wins. Size and positives of every group (about 100 bytes
    each) come to the driver, so this mode is for up to some ten million groups.
    """
    found = group_stats(df, group, label).orderBy("grp").toArrow()
    size, positive = (found[c].to_numpy().astype(np.int64) for c in ("size", "positives"))
    rows, rng = size.sum(), np.random.default_rng(seed)

    def prefix(order: np.ndarray) -> np.ndarray:
        return order[: 1 + np.count_nonzero(size[order].cumsum() < rows * fraction)]

    def distance(part: np.ndarray) -> float:
        held = size[part].sum()
        return abs(held / rows - fraction) + abs(positive[part].sum() / held - positive.sum() / rows)

    best = min((prefix(rng.permutation(len(size))) for _ in range(trials)), key=distance)
    return found["grp"].take(best).to_pylist()


def choose_groups_by_hash(df: DataFrame, fraction: float, seed: int, *, group: str = "domain_group", label: str = "label", trials: int = TRIALS) -> DataFrame:
    """Scale mode: the same search as one plan; trial t orders groups by a hash of seed, t and name. Returns (grp).

    Sizes are summed by trial and first hex digits of the hash, on the map side; a prefix sum over these buckets
    finds the one in which a trial reaches the fraction, and only its groups are sorted.
    """
    stats = group_stats(df, group, label)
    total = F.broadcast(stats.agg(F.sum("size").alias("n"), (F.sum("positives") / F.sum("size")).alias("rate")))
    hashed = lambda x: x.withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col("grp")))).withColumn("bucket", F.substring("at", 1, DIGITS))
    every = hashed(stats.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))))
    sums = every.groupBy("trial", "bucket").agg(F.sum("size").alias("b_size"), F.sum("positives").alias("b_positives"))
    earlier = Window.partitionBy("trial").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
    placed = sums.select("trial", "bucket", "b_size", before("b_size"), before("b_positives")).join(total)
    wanted = F.col("n") * fraction
    crossing = placed.filter((F.col("b_size_before") < wanted) & (F.col("b_size_before") + F.col("b_size") >= wanted)).drop("b_size")
    w = Window.partitionBy("trial").orderBy("at", "grp").rowsBetween(Window.unboundedPreceding, -1)
    inside = every.join(F.broadcast(crossing), ["trial", "bucket"]).withColumn("reached", F.col("b_size_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    taken = inside.filter(F.col("reached") < wanted).groupBy("trial").agg(
        (F.first("b_size_before") + F.sum("size")).alias("held"), (F.first("b_positives_before") + F.sum("positives")).alias("positive"), F.first("n").alias("n"), F.first("rate").alias("rate"), F.max(F.struct("at", "grp")).alias("last")
    )
    off = F.abs(F.col("held") / F.col("n") - fraction) + F.abs(F.col("positive") / F.col("held") - F.col("rate"))
    best = taken.agg(F.min_by(F.struct("trial", "last"), F.struct(F.round(off, 12), "trial")).alias("b")).select("b.trial", "b.last")
    return hashed(stats.join(F.broadcast(best))).filter(F.struct("at", "grp") <= F.col("last")).select("grp")


def make_split(df: DataFrame, test_seed: int, dev_seed: int, *, group: str = "domain_group", label: str = "label", mode: str = "parity") -> DataFrame:
    """Adds ``split``: test, validation or train, with groups in one of them only."""
    spark = df.sparkSession

    def pick(part: DataFrame, fraction: float, seed: int) -> DataFrame:
        if mode == "hash":
            return choose_groups_by_hash(part, fraction, seed, group=group, label=label)
        return spark.createDataFrame([(g,) for g in choose_groups(part, fraction, seed, group=group, label=label)], "grp string")

    test = pick(df, TEST, test_seed)
    rest = df.join(test, df[group] == test["grp"], "left_anti")
    validation = pick(rest, VALIDATION, dev_seed)
    named = test.withColumn("split", F.lit("test")).unionByName(validation.withColumn("split", F.lit("validation"))).withColumnRenamed("grp", group)
    return df.join(named, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def random_split(df: DataFrame, seed: int, key: str = "url_clean", label: str = "label") -> DataFrame:
    """``df`` with its train and validation rows dealt anew, stratified by label and not by group; test rows stay as they are."""
    development = df.filter("split <> 'test'")
    limits = development.groupBy(label).agg(F.round(F.count(F.lit(1)) * VALIDATION).cast("int").alias("k"))
    validation = take_smallest(development, [label], unit(seed, F.col(key)), [key], limits).select(key, F.lit(True).alias("_validation"))
    dealt = df.join(validation.distinct(), key, "left")
    split = F.when(F.col("split") == "test", "test").when(F.col("_validation"), "validation").otherwise("train")
    return dealt.withColumn("split", split).select(*df.columns)


def compare_splits(df: DataFrame, seed: int, group: str = "domain_group", key: str = "url_clean", label: str = "label") -> DataFrame:
    """(split_strategy, train_rows, validation_rows, train_domains, validation_domains, domain_overlap_count) of the given split and a random one."""
    out = None
    for name, rows in (("grouped", df), ("random_url", random_split(df, seed, key, label))):
        by_group = rows.filter("split <> 'test'").groupBy(group).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "validation").alias("v"))
        one = by_group.agg(
            F.sum("t").alias("train_rows"), F.sum("v").alias("validation_rows"), F.count_if(F.col("t") > 0).alias("train_domains"), F.count_if(F.col("v") > 0).alias("validation_domains"),
            F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("domain_overlap_count"),
        ).select(F.lit(name).alias("split_strategy"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def with_manifest(df: DataFrame, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """``df`` with the split that a manifest (key, split) gives each row; an error unless they match one to one."""
    both = df.select(key).withColumn("a", F.lit(1)).unionByName(manifest.select(key).withColumn("a", F.lit(-1)))
    if both.groupBy(key).agg(F.sum("a").alias("s"), F.count(F.lit(1)).alias("n")).filter("s <> 0 OR n <> 2").head(1):
        raise ValueError("the manifest and the table don't match one to one")
    return df.drop("split").join(manifest.select(key, "split"), key)


def split_summary(df: DataFrame, group: str = "domain_group", label: str = "label") -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("all_rows"))
    made = df.groupBy("split").agg(F.count(F.lit(1)).alias("samples"), F.sum(label).alias("phishing"), F.count_distinct(group).alias("domains"))
    return made.join(F.broadcast(total)).select("split", "samples", "phishing", "domains", (F.col("samples") - F.col("phishing")).alias("legitimate"), (F.col("samples") / F.col("all_rows")).alias("fraction"))


def leakage(df: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, leaks): values of each key that occur in several splits."""
    out = None
    for k in keys:
        one = df.groupBy(k).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("leaks")).select(F.lit(k).alias("kind"), "leaks")
        out = one if out is None else out.unionByName(one)
    return out


def validate_split(df: DataFrame, group: str = "domain_group", key: str = "url_clean", label: str = "label") -> DataFrame:
    by_split = {r["split"]: (r.n0, r.n1) for r in df.groupBy("split").agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).collect()}
    if set(by_split) != {"train", "validation", "test"}:
        raise ValueError("a split needs exactly train, validation and test")
    if not all(a and b for a, b in by_split.values()):
        raise ValueError("every split needs both classes")
    if leakage(df, [group, key]).filter("leaks > 0").head(1):
        raise ValueError("a group or URL occurs in several splits")
    return df


def training_fraction(df: DataFrame, fraction: float, seed: int, *, group: str = "domain_group", label: str = "label") -> DataFrame:
    """Train rows of a subset of groups that holds about the fraction; other splits as they are."""
    train = df.filter("split = 'train'")
    kept = df.sparkSession.createDataFrame([(g,) for g in choose_groups(train, fraction, seed, group=group, label=label)], "grp string")
    return df.filter("split <> 'train'").unionByName(train.join(kept, train[group] == kept["grp"], "left_semi"))


def confusion(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Counts and rates at a threshold; undefined rates are null."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    made = df.groupBy(*keys).agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp")
    )
    rate = lambda a, b: F.try_divide(F.expr(a), F.expr(b))
    return made.select(
        *keys, "tn", "fp", "fn", "tp",
        rate("tp + tn", "tn + fp + fn + tp").alias("accuracy"),
        rate("tp", "tp + fp").alias("precision"),
        rate("tp", "tp + fn").alias("recall"),
        rate("2 * tp", "2 * tp + fp + fn").alias("f1"),
        rate("fp", "fp + tn").alias("fpr"),
    )


def ranking_metrics(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC with ties as one half, and average precision by steps; null where undefined.

    Rows meet by score first, so the windows run over distinct scores.
    """
    by = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.select(*keys, "p", "n", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"))
    sums = run.groupBy(*keys).agg(
        F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("wins"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps")
    )
    return sums.select(*keys, F.try_divide("wins", F.col("np") * F.col("nn")).alias("roc_auc"), F.try_divide("steps", "np").alias("average_precision"))


def seed_summary(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean, sample deviation and extremes of metrics over seeds."""
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return metrics.groupBy(*keys).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in kinds.items()])


def _wrong(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    return df.filter((F.col(score) >= threshold) != (F.col(label) == 1))


def top_errors(df: DataFrame, keys: list[str], k: int = 5, score: str = "score", label: str = "label", ident: str = "sample_id", threshold: float = 0.5) -> DataFrame:
    """The k errors of each group with the smallest score, numbered by ``position``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(score, ident))
    return _wrong(df, score, label, threshold).withColumn("position", at).filter(F.col("position") <= k)


def errors_by_group(df: DataFrame, keys: list[str], group: str = "domain_group", score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Number of errors by keys, label and group, most first."""
    made = _wrong(df, score, label, threshold).groupBy(*keys, label, group).agg(F.count(F.lit(1)).alias("error_count"))
    return made.orderBy(F.desc("error_count"), *keys, label, group)


def top_importances(importances: DataFrame, k: int = 5, by: str = "model") -> DataFrame:
    """The k features of each model that matter most, with ``position``."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importance"), "feature"))
    return importances.withColumn("position", at).filter(F.col("position") <= k)


def with_url_flags(predictions: DataFrame, urls: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions with uses_https, has_query and inner_page of their URL (key, scheme, path, query), which stay null if it is unknown."""
    flags = urls.select(key, (F.col("scheme") == "https").alias("uses_https"), (F.col("query") != "").alias("has_query"), (~F.col("path").isin("", "/")).alias("inner_page"))
    return predictions.join(flags, key, "left")


def error_strata(df: DataFrame, flags: list[str], keys: list[str], score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    rows = df.withColumn("error", ((F.col(score) >= threshold) != (F.col(label) == 1)).cast("int"))
    long = rows.select(*keys, "error", *[F.col(f).cast("int").alias(f) for f in flags]).unpivot([*keys, "error"], flags, "flag", "flag_value")
    made = long.groupBy(*keys, "flag", "flag_value").agg(F.count(F.lit(1)).alias("rows"), F.sum("error").alias("errors"))
    return made.withColumn("error_rate", F.col("errors") / F.col("rows"))


def replay(new: DataFrame, old: DataFrame, keys: list[str], names: list[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(keys, matches): metrics equal within tolerance; a row that only one side has doesn't match."""
    a, b = new.select(*keys, *[F.col(n).alias(f"{n}_a") for n in names]), old.select(*keys, *[F.col(n).alias(f"{n}_b") for n in names])
    close = F.lit(True)
    for n in names:
        x, y = F.col(f"{n}_a"), F.col(f"{n}_b")
        close &= (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), keys, "full")
    return both.select(*keys, (F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False)) & close).alias("matches"))
