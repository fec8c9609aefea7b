import random

import numpy as np
import pytest

from urlloom.llm import ngram_join as nj


def brute(rows):
    sets = {i: frozenset(nj.shingle_set((t or "").encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n, words, near, common=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(common)]
    rows = []
    for _ in range(n):
        if rows and rng.random() < near:
            w = rng.choice(rows).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(*words))]
            if common and rng.random() < 0.6:
                w[len(w) // 2 : len(w) // 2] = passage
        rows.append(" ".join(w))
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "words", "near", "common", "block"), [(160, (1, 60), 0.6, 0, 256), (120, (200, 420), 0.7, 60, 256), (150, (20, 90), 0.8, 80, 8)])
def test_equals_brute_force(spark, n, words, near, common, block):
    rows = [*corpus(n, n, words, near, common), (5000, None), (5001, ""), (5002, "one two"), (5003, "ONE  two"), (5004, " \t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similarity_components(docs, block=block).collect()}
    assert got == brute(rows)


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    base = rng.choice(10_000, 120, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, 120 - k, replace=False), rng.integers(20_000, 90_000, k)])) for k in rng.integers(0, 30, 60)]
    index = nj.InvertedIndex(sets)
    for q in sets:
        want = {(m, len(np.intersect1d(q, s))) for m, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))}
        assert set(index.search(q)) == want
    assert list(nj.InvertedIndex([]).search(sets[0])) == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 3)], "u long, v long")
    got = {r.node: r.root for r in nj.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_per_component(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "x"), (2, text, "y"), (1, text, "x"), (3, None, "z"), (4, "", "z"), (5, "other text of some words", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((r.doc_id, r.key) for r in nj.one_per_component(docs).collect())
    assert got == [(1, "x"), (3, "z"), (4, "z"), (5, "q")]
    assert nj.one_per_component(docs.filter("false")).count() == 0


def test_rows_go_by_id_and_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    near = a.replace("a7", "other")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, None), (8, None), (9, b), (9, b), (None, b), (20, "x y z"), (20, "x y z"), (30, a + " tail"), (30, near + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in nj.one_per_component(docs, percent=95).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (8, None), (8, None), (None, b), (20, "x y z"), (30, near + " end")], key=str)


def test_long_and_repetitive_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "same " * 50_000), (4, "same " * 40_000), (5, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similarity_components(docs).collect()}
    assert got == {1: (59_997, 1), 2: (59_998, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5)}


def test_classes_that_share_half_a_key_stay_apart(spark):
    rows = [(7, 1, 1, 5, True), (7, 2, 2, 5, True), (8, 1, 3, 5, True), (9, 1, 4, 5, False)]
    classes = spark.createDataFrame(rows, "key long, key2 long, rep long, n long, stays boolean")
    nodes = {(r.key, r.key2): r.node for r in nj.survivor_table(classes).collect()}
    assert nodes.keys() == {(7, 1), (7, 2), (8, 1)} and len(set(nodes.values())) == 3 and nodes[7, 1] == 7


def test_meet_equals_a_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from urlloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 1).when(F.col("id") < 1600, 2).otherwise(F.col("id")).alias("k"), "id")
    table = rows.filter("k <> 2000").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    for how in ("inner", "left"):
        got = common.meet(rows, table, ["k"], "n", 3000, how)
        assert sorted(got.collect(), key=str) == sorted(rows.join(table, "k", how).collect(), key=str)


def test_discarded_tables_are_gone(spark):
    import os

    from urlloom.llm import common

    table = common.materialize(spark.range(5), "gone")
    path = common._paths[table].removeprefix("file:")
    assert os.path.isdir(path) and table.count() == 5
    common.discard(table)
    assert not os.path.exists(path)
