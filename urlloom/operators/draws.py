"""Seeded draws without a sort of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlloom.functions.seeds import unit

#: Hex digits of the order key that form a bucket: 4096 buckets a class.
DIGITS = 3


def take_smallest(rows: DataFrame, by: list[str], order: Column, ties: list[str], limits: DataFrame) -> DataFrame:
    """The ``k`` rows of each class with the smallest order key (lower-case hex text, evenly spread).

    ``limits``: one row a class with ``k``. Rows are counted by class and first digits of the key; whole
    buckets below the limit are taken as they are, and only the bucket in which it falls is sorted.
    """
    keyed = rows.withColumn("_key", order).withColumn("_bucket", F.substring("_key", 1, DIGITS))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_before", before).join(F.broadcast(limits), by)
    crossed = F.struct(F.col("_bucket").alias("_cut"), (F.col("k") - F.col("_before")).alias("_left"))
    inside = (F.col("_before") < F.col("k")) & (F.col("_before") + F.col("_n") >= F.col("k"))
    cuts = placed.groupBy(*by).agg(F.max(F.when(inside, crossed)).alias("_c"), F.first("k").alias("k"))
    # Hex digits are all below "g": a class without a crossing is taken whole, or not at all.
    cuts = cuts.select(*by, F.coalesce("_c._cut", F.when(F.col("k") > 0, "g").otherwise("")).alias("_cut"), F.coalesce("_c._left", F.lit(0)).alias("_left"))
    met = keyed.join(F.broadcast(cuts), by)
    at = F.row_number().over(Window.partitionBy(*by).orderBy("_key", *ties))
    edge = met.filter(F.col("_bucket") == F.col("_cut")).withColumn("_at", at).filter(F.col("_at") <= F.col("_left"))
    return met.filter(F.col("_bucket") < F.col("_cut")).select(*rows.columns).unionByName(edge.select(*rows.columns))


def group_candidates(rows: DataFrame, k: int, seed: int, *, group: str = "registered_domain", url: str = "url_clean") -> DataFrame:
    """One URL for each of k groups, both by a seeded hash: the draw of a phishing batch."""
    best = rows.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != group]), F.struct(unit(seed, F.lit("url"), F.col(url)), F.col(url))).alias("_r"))
    limits = rows.sparkSession.range(1).select(F.lit(1).alias("_all"), F.lit(k).alias("k"))
    chosen = take_smallest(best.withColumn("_all", F.lit(1)), ["_all"], unit(seed, F.lit("group"), F.col(group)), [group], limits)
    return chosen.select(*[F.col(group) if c == group else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def without_conflicts(controls: DataFrame, feed: DataFrame, key: str = "url_clean") -> DataFrame:
    """Control rows whose URL no feed row has; conflicting controls go without a substitute."""
    return controls.join(feed.select(key).distinct(), key, "left_anti")


def ranked_sample(rows: DataFrame, low: int, high: int, k: int, seed: int) -> DataFrame:
    """k of the candidates (rank, domain) with low <= rank <= high, by a seeded hash; an error if there are fewer."""
    pool = rows.filter(F.col("rank").between(low, high))
    if pool.count() < k:
        raise ValueError("the rank range holds fewer candidates than asked for")
    limits = rows.sparkSession.range(1).select(F.lit(1).alias("_all"), F.lit(k).alias("k"))
    return take_smallest(pool.withColumn("_all", F.lit(1)), ["_all"], unit(seed, F.col("rank").cast("string"), F.col("domain")), ["rank", "domain"], limits).drop("_all")


def best_ranks(rows: DataFrame, taken: DataFrame, group: str = "registered_domain") -> DataFrame:
    """(group, rank, domain): the best-ranked candidate of each group that ``taken`` lacks."""
    left = rows.join(taken.select(group).distinct(), group, "left_anti")
    return left.groupBy(group).agg(F.min(F.struct("rank", "domain")).alias("_b")).select(group, "_b.rank", "_b.domain")


def positioned(rows: DataFrame, by: str, order: list[str], name: str = "at") -> DataFrame:
    """``by``, ``order`` and the position from 0 within ``by``, without a task that holds a whole class.

    Rows are dealt by range of (``by``, ``order``) and sorted within; the counts of the ranges, one row for
    each class in a range, are summed up and broadcast. Rows of a null class get no position.
    """
    dealt = rows.select(by, *order).orderBy(by, *order).withColumn("_id", F.monotonically_increasing_id()).persist()
    ranged = dealt.withColumn("_range", F.shiftright("_id", 33))
    counts = ranged.groupBy(by, "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(by, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    return ranged.join(F.broadcast(starts), [by, "_range"]).select(by, *order, (F.col("_id") + F.col("_start")).alias(name))
