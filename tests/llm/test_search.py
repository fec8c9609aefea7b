import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlloom.llm import decontaminate as dc
from urlloom.llm import vantage_point as vp


def vectors(spark, n=700, dim=8):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dim).round(2).tolist()) for i in range(n)]
    rows += [(10_000 + i, [1.0, 2.0] + [0.0] * (dim - 2)) for i in range(200)]  # a hot vector
    rows += [(20_000, None), (20_050, [0.0] * dim), (20_100, [float("nan")] + [1.0] * (dim - 1)), (20_150, [None] + [1.0] * (dim - 1)), (20_200, []), (20_250, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize(("shard_rows", "shard_bytes"), [(8192, 32 << 20), (100, 32 << 20), (8192, 4000)])
def test_exact_search_equals_brute_force(spark, shard_rows, shard_bytes):
    rows, df = vectors(spark)
    got = {}
    for r in vp.nearest(df.withColumn("rank", F.lit(1)), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, shard_bytes=shard_bytes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {i: np.array(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in ok:
        if q % 50 == 0 and len(ok[q]) == 8:
            near = sorted((-vp.cosines(v[None, :], np.sqrt(vp._squares(v[None, :])), ok[q])[0], i) for i, v in ok.items() if i != q and len(v) == 8)[:5]
            assert sorted(got.pop(q)) == [(k + 1, i, -c) for k, (c, i) in enumerate(near)]
    assert not got


def test_relaxed_search_keeps_recall(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 6))
    tree = vp.Tree(points)
    hits = 0
    for q in points[:50]:
        exact, relaxed = ({i for _, i in tree.search(q, 5, r)[:5]} for r in (1.0, 1.3))
        hits += len(exact & relaxed)
    assert hits / 250 >= 0.9


def test_extreme_magnitudes_and_repeated_ids(spark):
    rows = [(50, [2.0**-700, 2.0**-699]), (1, [2.0**1000, 2.0**1001]), (2, [2.0**-1060, 2.0**-1061]), (3, [1.0, 2.0]), (3, [2.0, 1.0]), (100, [1.0, 2.0]), (100, [2.0, 1.0])]
    got = {}
    for r in vp.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert sorted(got[50]) == [(1, 1, 1.0), (2, 3, 1.0), (3, 100, 1.0)]
    assert sorted(got[100]) == [(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (2, 3, 1.0), (3, 1, 0.8), (3, 50, 1.0)]


@pytest.mark.parametrize("relax", [1.05, 1.15])
def test_relaxed_recall_on_embeddings(spark, relax):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = [{(r.query_id, r.vec_id) for r in vp.nearest(vectors, F.col("vec_id") % 50 == 0, relax=x).collect()} for x in (1.0, relax)]
    assert len(found[0] & found[1]) >= 0.9 * len(found[0])


def test_no_vectors(spark):
    _, df = vectors(spark, 3)
    assert vp.nearest(df.filter("false"), F.lit(True)).count() == 0
    assert vp.nearest(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def stretches(same):
    """The best (matched, -length, -start) of all stretches at a rate of 0.8."""
    found = [(sum(same[i:j]), i - j, -i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and 5 * sum(same[i:j]) >= 4 * (j - i)]
    return max(found, default=(0, 0, 0))


def brute(docs, items):
    out = set()
    for d, t in docs:
        a = dc.tokens(t or "").tolist()
        for i, u in items:
            b = dc.tokens(u or "").tolist()
            needed = min(dc.MIN_MATCHED, -(-8 * len(b) // 10))
            for shift in range(-len(b) + 1, len(a)):
                same = [a[shift + k] == b[k] for k in range(len(b)) if 0 <= shift + k < len(a)]
                if sum(same) >= max(1, needed) and stretches(same)[0] >= needed:
                    out.add((d, i))
    return out


def test_best_overlap_equals_all_stretches():
    rng = random.Random(3)
    for _ in range(800):
        same = [rng.random() < rng.choice([0.6, 0.8, 0.9]) for _ in range(rng.randint(0, 24))]
        matched, n, start = stretches(same)
        assert dc.best_overlap(same) == (-start, -n, matched)


def test_planted_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randint(25, 50)))) for i in range(12)] + [(50, "a short item of six words"), (51, None), (52, ""), (53, "...")]
    items.append((60, items[0][1]))  # a repeated item
    docs = [(i, " ".join(word() for _ in range(120))) for i in range(40)]
    for i in range(40, 80):
        w = items[i % 12][1].split()
        for _ in range(len(w) // 10):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join([*(word() for _ in range(rng.randint(0, 60))), *w, word(), "Tail."]).upper()))
    docs += [(90, "see A short item, of six words!"), (91, None), (92, ""), (93, " ".join(items[3][1].split()[:8])), (40, docs[40][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.contaminated_pairs(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(docs, items) and len(rows) == len(got)
    assert {d for d, _ in got} == {*range(40, 80), 90}
    assert {r.doc_id for r in dc.drop_contaminated(df, bench).collect()} == {*range(40), 91, 92, 93}
    assert dc.contaminated_pairs(df, bench.filter("false")).count() == 0
    assert dc.contaminated_pairs(df.filter("false"), bench).count() == 0


def _qualifies(same, n_item):
    return stretches(same)[0] >= min(dc.MIN_MATCHED, -(-8 * n_item // 10))


@pytest.mark.parametrize("n", [*range(1, 13), 14, 15, 16, 18, 20, 25, 32, 48])
@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
def test_seed_recall(n, rate):
    """Share of overlaps that count and that a seed meets; below 12 words, and at the ends of a text, no one is missed."""
    rng = random.Random(n)
    short = (n,) if n < dc.SPAN else ()
    met = tried = 0
    for _ in range(300):
        item = np.array([rng.getrandbits(60) for _ in range(n)], np.uint64)
        same = [True] * n
        for i in rng.sample(range(n), int(rate * n)):
            same[i] = False
        if not _qualifies(same, n):
            continue
        text = np.array([w if x else rng.getrandbits(60) for w, x in zip(item, same, strict=True)], np.uint64)
        around = [np.array([rng.getrandbits(60) for _ in range(rng.choice([0, 3]))], np.uint64) for _ in range(2)]
        text = np.concatenate([around[0], text, around[1]])
        own = {int(dc._hashes(item, m, n)[0]): {0} for m in dc.short_masks(n)} if short else {}
        for at, h in dc.seeds(item) if not short else ():
            for a, x in zip(at.tolist(), h.tolist(), strict=True):
                own.setdefault(x, set()).add(a)
        tried += 1
        met += any(a - b == len(around[0]) for at, h in dc.seeds(text, short) for a, x in zip(at.tolist(), h.tolist(), strict=True) for b in own.get(x, ()))
    assert tried and met >= (1.0 if short else 0.95) * tried


def test_short_items_with_a_substitution_and_cut_ends(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    words = item.split()
    docs = [(1, " ".join(["x", *words[:4], "other", *words[5:], "y"])), (2, " ".join(words[2:])), (3, " ".join(words[:8])), (4, " ".join(words[:7])), (5, " ".join([*words[:2], "o", *words[3:6], "p", *words[7:]])), (6, " ".join(["q", "r", "s", *words[3:]]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in dc.contaminated_pairs(df, bench).collect()} == {1, 2, 3, 5} == {d for d, _ in brute(docs, [(1, item)])}


def test_long_repetitive_texts_and_hot_seeds(spark, monkeypatch):
    rng = random.Random(8)
    passage = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30))
    docs = [(1, "same " * 20_000), (2, "other " * 30)] + [(10 + i, f"w{i} {passage} v{i}") for i in range(300)] + [(None, passage)]
    bench = spark.createDataFrame([(1, "same " * 30), (2, passage)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {(1, 1), (None, 2)} | {(10 + i, 2) for i in range(300)}
    for limit in (dc.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(dc, "BROADCAST_SEEDS", limit)
        got = dc.contaminated_pairs(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all((r.start, r.words, r.matched) == (0, 30, 30) for r in got if r.doc_id == 1)
