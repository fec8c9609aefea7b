import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlloom.llm import catalogue, line_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_boilerplate_lines_go(spark):
    rows = [(i, f"menu\nown {i}\n\n menu \r", "en", "a", 1) for i in range(8)] + [(100 + i, "menu\nrare" if i == 0 else f"x{i}", "en", "b", 1) for i in range(20)]
    rows += [(200, None, "en", "a", 1), (201, "", "en", None, 1), (202, "menu", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for few in (100_000, 0):  # the broadcast and the salted join
        got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, ratio=0.5, broadcast_lines=few).collect()}
        assert got[3].text == "own 3\n" and got[3].n_lines == 4 and got[3].n_dropped == 2
        assert got[100].text == "menu\nrare"
        assert got[200].text is None and got[200].n_lines == 0
        assert got[201].text == "" and got[202].text == "menu"
        assert len(got) == len(rows)


def test_line_dedup_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "s", "h", "k")], "doc_id long, text string, source string, host string, _b_keys string")
    assert line_dedup.drop_boilerplate(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.drop_boilerplate(docs.filter("false")).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.05, 1.0, 7.5, 120.0])
def test_poisson_counts(spark, rate):
    got = spark.range(200).select((F.col("id") / 200).alias("u")).select("u", mixing.poisson_count(F.col("u"), F.lit(rate)).alias("k")).collect()
    for r in got:
        cdf, term, k = math.exp(-rate), math.exp(-rate), 0
        while cdf <= r.u and rate:
            k += 1
            term *= rate / k
            cdf += term
        assert r.k == k


def test_mixing_follows_weights(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") < 2000, "big").when(F.col("id") < 2900, "mid").otherwise("rare").alias("source"), F.lit(1).alias("copy"))
    weights = spark.createDataFrame([("big", 1.0), ("rare", 1.0)], "source string, weight double")
    for most in (50_000, 0):
        got = mixing.mix(docs, mixing.rates_for(docs, weights), broadcast_rates=most).collect()
        n = Counter(r.source for r in got)
        assert n["mid"] == 0 and abs(n["big"] - 1500) < 150 and abs(n["rare"] - 1500) < 250
        copies = Counter(r.doc_id for r in got)
        assert all(sorted(x.copy_no for x in got if x.doc_id == d) == list(range(1, copies[d] + 1)) for d in list(copies)[:20])
    assert mixing.mix(docs.filter("false"), mixing.tempered_rates(docs)).count() == 0


def test_mixing_null_source_and_repeats(spark):
    docs = spark.createDataFrame([(i % 30, "a", None) for i in range(60)] + [(None, None, "s")], "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.tempered_rates(docs, temperature=1.0)).filter("source is null").collect()
    n = Counter((r.doc_id, r.copy_no) for r in got)
    assert got and set(n.values()) == {2}  # both rows of an id draw alike


@pytest.mark.parametrize("name", ["op3_rank_order_language_id", "op4_spaced_seed_decontamination", "op5_poisson_mixing", "op7_line_dedup", "op6_ngram_jaccard_join", "op8_vantage_point_neighbours", "op1_warc_index_merge"])
def test_queries_equal_their_sql(spark, name):
    from oracle import compare

    assert compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.001") is None


def test_names_of_own_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s", 7, 8, 9), (1, "a\nb", "s", 7, 8, 9), (2, "x " * 200_000, "s", 7, 8, 9)], "doc_id long, text string, source string, n_lines int, n_dropped int, copy_no int")
    cut = line_dedup.drop_boilerplate(docs)
    assert cut.columns == ["doc_id", "text", "source", "copy_no", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in cut.collect()) == [(1, 2, 2), (1, 2, 2), (2, 1, 0)]
    assert line_dedup.without_boilerplate(docs).columns == docs.columns
    mixed = mixing.mix(docs, mixing.tempered_rates(docs))
    assert mixed.columns == ["doc_id", "text", "source", "n_lines", "n_dropped", "copy_no"] and mixed.count() >= 0


def test_small_hosts_go_by_the_ratio(spark):
    docs = spark.createDataFrame([(i, f"menu\nown {i}", "en", "a", 1) for i in range(4)] + [(9, "alone", "en", "b", 1)], DOCS)
    assert {r.text for r in line_dedup.drop_boilerplate(docs).collect()} == {"own 0", "own 1", "own 2", "own 3", "alone"}
