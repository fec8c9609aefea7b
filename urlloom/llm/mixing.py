"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's repetition rate is its target share of the output divided by its share of the
input. Each document draws its number of copies from a Poisson distribution with that
mean, by inverting the distribution at a number in [0, 1) hashed from seed and doc id;
the copies are then dealt out in the order of another hash, which shuffles globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlloom.llm.common import materialize

SEED = 20250101
TEMPERATURE = 0.7


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def tempered_rates(docs: DataFrame, *, source: str = "source", text: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """(source, size, weight, rate): target weights proportional to size ** temperature.

    Size is the source's bytes of text (null: 0), at least 1. The output is as large as the
    input in expectation.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.greatest(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")), F.lit(1).cast("long")).alias("size")
    )
    power = F.pow(F.col("size").cast("double"), F.lit(temperature))
    totals = sizes.agg(F.sum("size").alias("all_size"), F.sum(power).alias("all_power"))
    return sizes.join(F.broadcast(totals)).select(
        "source",
        "size",
        (power / F.col("all_power")).alias("weight"),
        (power / F.col("all_power") * F.col("all_size") / F.col("size")).alias("rate"),
    )


def rates_for(docs: DataFrame, weights: DataFrame, *, source: str = "source", text: str = "text") -> DataFrame:
    """Rates for a given table (source, weight); sources that it lacks get rate 0."""
    sizes = tempered_rates(docs, source=source, text=text).select("source", "size")
    joined = sizes.join(weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w")), F.expr("source <=> _s"), "left")
    totals = joined.agg(F.sum("size").alias("all_size"), F.sum("_w").alias("all_w"))
    return joined.join(F.broadcast(totals)).select(
        "source",
        "size",
        F.coalesce(F.col("_w") / F.col("all_w"), F.lit(0.0)).alias("weight"),
        F.coalesce(F.col("_w") / F.col("all_w") * F.col("all_size") / F.col("size"), F.lit(0.0)).alias("rate"),
    )


def poisson_count(unit: Column, rate: Column) -> Column:
    """Smallest k whose Poisson probability of at most k exceeds ``unit``.

    Terms are made up to rate + 12 * sqrt(rate) + 20, beyond which less than 2 ** -52
    remains. Above a rate of 700 they are made as logarithms, as exp(-rate) would underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    state = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k")),
        lambda s, i: F.struct(
            (s["term"] * rate / i).alias("term"),
            (s["cdf"] + s["term"] * rate / i).alias("cdf"),
            (s["k"] + F.when(s["cdf"] <= unit, 1).otherwise(0)).alias("k"),
        ),
        lambda s: s["k"],
    )
    large = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("log_term"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k")),
        lambda s, i: F.struct(
            (s["log_term"] + F.log(rate / i)).alias("log_term"),
            (s["cdf"] + F.exp(s["log_term"] + F.log(rate / i))).alias("cdf"),
            (s["k"] + F.when(s["cdf"] <= unit, 1).otherwise(0)).alias("k"),
        ),
        lambda s: s["k"],
    )
    return F.when(rate > 700, large).when(rate > 0, state).otherwise(0)


def mix(docs: DataFrame, rates: DataFrame, *, doc_id: str = "doc_id", source: str = "source", seed: int = SEED, broadcast_rates: int = 50_000) -> DataFrame:
    """Each row of ``docs`` as often as drawn, in globally shuffled order; adds copy_no (from 1).

    ``rates`` has (source, rate), one row a source. Repeated ids draw alike; a null id draws
    like any other value; a null source is a source. Rows of sources without a rate go. All
    input columns stay, whatever their names, but one called copy_no, which gives way; texts pass by whole. A draw depends on seed and id only, so lost
    executors recompute the same copies.

    Rates are broadcast if they number at most ``broadcast_rates``, which is counted first;
    else the join shuffles, and adaptive execution splits a source that holds much of the rows.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rates = materialize(rates.select(F.col("source").alias("_s"), F.col("rate").alias("_rate")), "rates")
    if rates.limit(broadcast_rates + 1).count() <= broadcast_rates:
        rates = F.broadcast(rates)
    keyed = row.join(rates, F.col(f"_row.`{source}`").eqNullSafe(F.col("_s")))
    unit = hashed_unit(F.lit(seed), F.col(f"_row.`{doc_id}`"))
    drawn = keyed.select("_row", poisson_count(unit, F.col("_rate")).alias("_k")).filter("_k > 0")
    copies = drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("copy_no"))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(f"_row.`{doc_id}`").cast("string"), F.lit("null")), F.col("copy_no")))
    dealt = copies.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order")
    return dealt.select(*[F.col(f"_row.`{c}`").alias(c) for c in names if c != "copy_no"], "copy_no")
