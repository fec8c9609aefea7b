import math
from collections import Counter

from pyspark.sql import functions as F

from urlloom.llm import mixing


def _draw(unit, rate):
    k, cdf = 0, math.exp(-rate)
    while cdf <= unit:
        k += 1
        cdf += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


def test_poisson_count_at_large_rates(spark):
    pairs = [(u, r) for r in (699.0, 701.0, 1389.0, 5000.0) for u in (0.0001, 0.3, 0.5, 0.77, 0.9999)]
    rows = spark.createDataFrame(pairs, "u double, rate double").withColumn("k", mixing.poisson_count(F.col("u"), F.col("rate"))).collect()
    assert len(rows) == len(pairs) and all(r.k == _draw(r.u, r.rate) for r in rows)


def test_mixing_a_source_with_a_large_rate(spark):
    docs = spark.createDataFrame([(i, "x", "tiny" if i < 3 else "big") for i in range(20)], "doc_id long, text string, source string")
    rates = spark.createDataFrame([("tiny", 1389.0), ("big", 0.9)], "source string, rate double")
    copies = Counter(r.doc_id for r in mixing.mix(docs, rates).collect())
    assert all(abs(copies[i] - 1389) < 6 * math.sqrt(1389) for i in range(3))
