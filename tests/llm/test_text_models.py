import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlloom.llm import context_tree as ct
from urlloom.llm import language_id, license_scan, quality

SF = "/root/testdata/sf0.01"


def test_language_rank_order_equals_brute_force(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the end and the rest", "en"), (4, None, "en"), (5, "123 !!", None), (6, "", "de"), (7, "the", None)],
        "doc_id long, text string, lang string",
    )
    profiles = language_id.train_profiles(docs)
    assert set(profiles) == {"en", "de"}
    got = {r.doc_id: r for r in language_id.predict(docs.withColumn("score", F.lit("x")), profiles).collect()}
    for t, i in (("the cat and the dog", 1), ("the", 7)):
        grams, counts = language_id.gram_counts(t)
        own = [g for _, g in sorted(zip((-counts).tolist(), grams.tolist(), strict=True))][: language_id.PROFILE]
        sums = {n: sum(abs(p.index(g) - k) if g in p else language_id.PROFILE for k, g in enumerate(own)) for n, p in profiles.items()}
        best = min(sorted(sums), key=sums.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - 0.5 * sums[best] / max(sums.values()))
    assert [(got[i].lang_pred, got[i].score) for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert language_id.predict(docs.filter("false"), profiles).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train_profiles(docs.filter("false"))).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    from urlloom.llm.catalogue import op3_rank_order_language_id

    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op3_rank_order_language_id(spark, SF).filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.97


def test_quality_held_out(spark):
    from urlloom.llm.catalogue import op10_fourier_quality

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op10_fourier_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x", 5), (4, "word " * 50_000, 5), (4, "word " * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (9, None)], "doc_id long, quality int")
    got = quality.train_and_score(docs, labels, features=16).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.train_and_score(docs, labels.filter("false"), features=16).collect()} == {0.5}
    assert {r.score for r in quality.train_and_score(docs, labels.filter("quality = 1"), features=16).collect()} == {1.0}


def test_isotonic():
    x, y = np.arange(6.0), np.array([0.0, 0.5, 0.2, 0.4, 1.0, 0.9])
    knots, values = quality.isotonic(x, y, np.ones(6))
    assert (np.diff(values) >= 0).all() and np.interp(1.0, knots, values) == pytest.approx(0.35)


def _nodes(texts, depth):
    nodes = {}
    for t in texts:
        data = bytes([255]) * depth + t + bytes([255])
        for i in range(depth, len(data)):
            for b in range(8):
                path, bit = (1 << b) | (data[i] >> (8 - b)), (data[i] >> (7 - b)) & 1
                for d in range(depth + 1):
                    nodes.setdefault((d, data[i - d : i], path), [0, 0])[bit] += 1
    return nodes


def _log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def test_context_tree_equals_brute_force(spark):
    depth, texts = 2, [b"abracadabra", b"abba", b"", b"banana bandana"]
    nodes = _nodes(texts, depth)
    stop, log_w = {}, {}
    for d in range(depth, -1, -1):
        for (level, c, path), (a, b) in nodes.items():
            if level == d:
                own = _log_kt(a, b)
                if d == depth:
                    log_w[d, c, path], stop[d, c, path] = own, 1.0
                else:
                    below = sum(v for (k, cc, pp), v in log_w.items() if k == d + 1 and pp == path and cc[1:] == c)
                    log_w[d, c, path] = math.log(0.5) + np.logaddexp(own, below)
                    stop[d, c, path] = math.exp(math.log(0.5) + own - log_w[d, c, path])

    def score(t):
        total, data = 0.0, bytes([255]) * depth + t + bytes([255])
        for i in range(depth, len(data)):
            for b in range(8):
                path, bit = (1 << b) | (data[i] >> (8 - b)), (data[i] >> (7 - b)) & 1
                p, deeper = 0.5, False
                for d in range(depth, -1, -1):
                    k = (d, data[i - d : i], path)
                    if k in nodes:
                        w = stop[k] if deeper else 1.0
                        p, deeper = w * (nodes[k][1] + 0.5) / (sum(nodes[k]) + 1) + (1 - w) * p, True
                    else:
                        p, deeper = 0.5, False
                total += math.log10(p if bit else 1 - p)
        return total

    train = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = ["Banana", "abrakadabra", "", None, "zzz"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in ct.score(docs, train, depth=depth, slot_bits=18).collect()}
    for i, t in enumerate(asked):
        assert got[i].score == pytest.approx(score((t or "").lower().encode()), rel=1e-5)
    words = [w for t in texts for w in (*t.split(), b"END")]
    n, v = len(words), len(set(words))
    base = math.log10((words.count(b"END") + 0.1) / (n + 0.1 * (v + 1)))
    assert got[2].base_score == pytest.approx(base) and got[2].n_tokens == 1 and got[0].n_known == 2 and got[0].train_tokens == n
    assert ct.score(docs.filter("false"), train, depth=1, slot_bits=12).count() == 0


def test_context_tree_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([(1, "some text to learn from, some more text")], "doc_id long, text string")
    table = ct.tree_table(ct.tree(ct.count_table(train, depth=3), 3), 3, 6)  # few slots: many lost nodes
    for context in (0xFFFFFF, 0x736F6D, 0x010203):
        p = 10 ** table.log10(np.array([(context << 8) | b for b in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1.0)


def test_licences(spark):
    rows = [
        (1, "intro line\nLicensed under the Apache License, Version 2.0.\nbody"),
        (2, "Released under the MIT License."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "All rights reserved."),
        (5, "we reserved all the best seats under the roof of the public hall\nthe license of the driver"),
        (6, None),
        (7, ""),
        (8, "word " * 20_000 + "Licensed under CC BY-NC 4.0"),
        (2, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in license_scan.scan(docs).collect())
    assert got == [(1, 1, "apache-2.0", True), (2, 0, "mit", True), (2, 0, "mit", True), (3, 0, "gpl-3.0", True), (4, 0, "all-rights-reserved", True), (8, 0, "cc-by-nc-4.0", True)]


def test_quality_fit_equals_plain_algebra(spark):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta,", "gamma.", "DELTA", "x1", "and", "the", "##"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(3, 60))), int(rng.integers(0, 2))) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:90]], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.train_and_score(docs, labels, features=12).collect()}
    fold_of = docs.selectExpr("doc_id", f"cast(pmod(xxhash64(text, 1), {quality.FOLDS}) as int) AS fold")
    folds = {r.doc_id: r.fold for r in fold_of.collect()}
    x = np.array([quality.statistics(t.encode()) for _, t, _ in rows])
    train, y, fold = x[:90], np.array([r[2] for r in rows[:90]], float), np.array([folds[i] for i in range(90)])
    mean, scale = train.mean(0), np.sqrt(np.maximum((train**2).mean(0) - train.mean(0) ** 2, 1e-12))
    rng = np.random.default_rng(7)
    weights, phases = rng.normal(size=(x.shape[1], 12)) / math.sqrt(x.shape[1]), rng.uniform(0, 2 * math.pi, 12)
    f = np.hstack([np.cos(np.clip((x - mean) / scale, -6, 6) @ weights + phases) * math.sqrt(2 / 12), np.ones((len(x), 1))])
    penalty = np.diag([1e-3 * 90 / 12] * 12 + [1e-9 * 90])
    solve = lambda keep: np.linalg.solve(f[:90][keep].T @ f[:90][keep] + penalty, f[:90][keep].T @ y[keep])
    out_of_fold = np.array([f[i] @ solve(fold != fold[i]) for i in range(90)])
    at = np.clip(((out_of_fold + 0.5) / 2 * 512).astype(int), 0, 511)
    bins = sorted(set(at))
    knots, values = quality.isotonic(np.array([(b + 0.5) / 512 * 2 - 0.5 for b in bins]), np.array([y[at == b].mean() for b in bins]), np.array([float((at == b).sum()) for b in bins]))
    want = np.interp(f @ solve(np.ones(90, bool)), knots, values)
    assert [got[i] for i in range(120)] == pytest.approx(want.tolist(), abs=1e-6)


def test_quality_sample_bound_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(i, f"Good text number {i}." if i % 2 else f"## $$ {i} %%") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    got = quality.train_and_score(docs, labels, features=16, sample=200).collect()
    assert len(got) == 401 and all((r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None)
    assert quality.train_and_score(docs.filter("false"), labels, features=16).count() == 0
    assert {r.doc_id for r in quality.drop_low(docs, labels, least=0.3, features=16).collect()} >= set(range(1, 400, 2))


def test_licence_scan_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").select("doc_id", "text")
    model = license_scan.train(spark, docs)
    assert model.calibration["rows"] > 100 and model.calibration["accuracy"] > 0.95 and model.calibration["log_loss"] < 0.2
    assert 0.3 < model.calibration["accuracy_of_unseen_sentences"] < model.calibration["accuracy"]
    weights = dict(zip(model.vocabulary, model.weights, strict=True))
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w: {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
    want = {}
    for r in docs.collect():
        for k, line in enumerate(re.sub(r"(?<![.!?:;\s])[ \t]*\r?\n(?=[ \t]*[a-z])", " ", r.text or "").split("\n")):
            z = np.array(model.intercepts) + sum((np.array(weights[g]) for g in grams(words(line)) if g in weights), np.zeros(len(model.families)))
            p = np.exp((z - z.max()) / model.temperature)
            p /= p.sum()
            if p.argmax() < len(p) - 1 and p.max() >= 0.5:
                own = [grams(words(t)) for t in license_scan.TEMPLATES[model.families[p.argmax()]]]
                want[r.doc_id, k] = (model.families[p.argmax()], p.max(), p[-1], max(len(o & grams(words(line))) / len(o) for o in own))
    got = {(r.doc_id, r.paragraph): (r.family, r.probability, r.unknown, r.coverage) for r in license_scan.scan(docs, model).collect()}
    assert got.keys() == want.keys() and want
    for k, (family, p, unknown, share) in want.items():
        assert got[k][0] == family and got[k][1:] == pytest.approx((p, unknown, share), abs=2e-6)


def test_wrapped_licences_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "Notes.\nThis work is licensed under the GNU General\n  Public License,\nversion 3.\nNext Line"), (1, "plain words only here")], "doc_id long, text string")
    model = license_scan.train(spark)
    assert [(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(docs, model).collect()][0][2] in license_scan.TEMPLATES
    assert license_scan.scan(docs.filter("false")).count() == 0


def test_language_of_ties_repeats_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "aaa", "xx"), (2, "aaa", "aa"), (3, "aaa " * 200_000, None), (3, "aaa " * 200_000, None), (None, "bbb", None)], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train_profiles(docs)).collect()))
    assert [(i, p) for i, p, _ in got] == [(0, "aa"), (1, "aa"), (2, "aa"), (3, "aa"), (3, "aa")] and {s for _, _, s in got} == {0.5}


def test_language_query_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    profiles = language_id.train_profiles(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    for r in docs.collect():
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in r.text)
        joined = " " + " ".join(low.split(" ")).strip() + " "
        joined = re.sub(" +", " ", joined)
        counts = {}
        for n in language_id.LENGTHS:
            for i in range(len(joined) - n + 1):
                g = joined[i : i + n]
                if (n > 1 or g != " ") and " " not in g[1:-1]:
                    counts[sum(ord(c) << (21 * (n - 1 - k)) for k, c in enumerate(g))] = counts.get(sum(ord(c) << (21 * (n - 1 - k)) for k, c in enumerate(g)), 0) + 1
        own = sorted(counts, key=lambda g: (-counts[g], g))[: language_id.PROFILE]
        sums = {name: sum(abs(p.index(g) - k) if g in set(p) else language_id.PROFILE for k, g in enumerate(own)) for name, p in profiles.items()}
        assert got[r.doc_id].lang_pred == min(sorted(sums), key=sums.get)


def test_context_tree_repeats_null_ids_and_long_texts(spark):
    train = spark.createDataFrame([(1, "some words to learn, some more")], "doc_id long, text string")
    docs = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "some words"), (2, "words " * 100_000)], "doc_id long, text string")
    got = ct.score(docs, train, depth=3).collect()
    assert len(got) == 4 and len({r.score for r in got if r.n_tokens == 3}) == 1
    assert [r.n_tokens for r in got if r.doc_id == 2] == [100_001] and all(r.score < 0 for r in got)


def test_base_scores_equal_counts(spark):
    from urlloom.llm.catalogue import op9_context_tree_weighting

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    import zlib

    tokens = {r.doc_id: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())] + [b""] for r in docs}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = {}
    for i, ws in tokens.items():
        for w in ws if not out[i] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in op9_context_tree_weighting(spark, "/root/testdata/sf0.001").collect()}
    for i, ws in tokens.items():
        want = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (out[i], len(ws), sum(w in counts for w in ws), n)
        assert got[i].base_score == pytest.approx(want) and got[i].score > got[i].base_score * 1.5
