import numpy as np
import pytest
from pyspark.sql import functions as F

from urlloom.operators import analysis, modelling, observations, pages, split
from urlloom.streaming.feeds import cleaned_stream, window_counts


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"g{i:02d}", i % 2, f"u{i}-{j}") for i in range(40) for j in range(1 + i % 5)]
    return spark.createDataFrame(rows, "domain_group string, label int, url_clean string").cache()


def test_group_search_equals_a_plain_loop(groups):
    stats = sorted((r.domain_group, r.n, r.p) for r in groups.groupBy("domain_group").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect())
    total, rate = sum(x[1] for x in stats), sum(x[2] for x in stats) / sum(x[1] for x in stats)
    rng, best = np.random.default_rng(9), None
    for _ in range(split.TRIALS):
        count = positives = 0
        taken = []
        for i in rng.permutation(len(stats)):
            if count >= total * 0.15:
                break
            taken.append(stats[i][0])
            count += stats[i][1]
            positives += stats[i][2]
        off = abs(count / total - 0.15) + abs(positives / count - rate)
        if best is None or off < best[0]:
            best = off, taken
    assert split.choose_groups(groups, 0.15, 9) == best[1]


@pytest.mark.parametrize("mode", ["parity", "hash"])
def test_splits(groups, mode):
    made = split.make_split(groups, 1, 2, mode=mode)
    again = split.make_split(groups.repartition(7), 1, 2, mode=mode)
    assert made.exceptAll(again).count() == 0
    split.validate_split(made)
    other = split.make_split(groups, 1, 3, mode=mode)
    test = lambda d: {r.domain_group for r in d.filter("split = 'test'").collect()}
    assert test(made) == test(other)


def test_leaks_are_errors(groups):
    with pytest.raises(ValueError):
        split.validate_split(split.random_split(split.make_split(groups, 1, 2), 1))


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.8), (1, 0.4), (1, 0.9)], "label int, score double").withColumn("k", F.lit(1))
    r = split.confusion(df, ["k"]).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.fpr) == (1, 1, 1, 1, 0.5)
    m = split.ranking_metrics(df, ["k"]).first()
    assert (m.roc_auc, m.average_precision) == (0.75, pytest.approx(5 / 6))
    assert split.ranking_metrics(df.filter("label = 1"), ["k"]).first().roc_auc is None


def test_imputer_and_scaler(spark):
    train = spark.createDataFrame([(10.0, None, 1.0), (20.0, None, 1.0), (30.0, None, 1.0), (40.0, None, 1.0), (None, None, 1.0)], "a double, b double, c double")
    imputer = modelling.Imputer(train, ["a", "b", "c"])
    assert imputer.medians == {"a": 25.0, "b": 0.0, "c": 1.0} and imputer.outputs == ["a", "b", "c", "a_missing", "b_missing"]
    scaler = modelling.Scaler(imputer.transform(train), ["a", "c"])
    assert scaler.stats["c"] == (1.0, 1.0) and scaler.stats["a"] == (25.0, 10.0)


def test_logistic_regression_equals_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0).astype(int)
    df = spark.createDataFrame([(int(b), float(a[0]), float(a[1])) for a, b in zip(x, y, strict=True)], "label int, a double, b double")
    got = dict(modelling.Fitted(df, ["a", "b"], "logistic_regression", {"C": 1.0}, 0).importances())
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((120, 1))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) + np.array([w[0], w[1], 0])
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 0]), g)
    assert got["a"] == pytest.approx(w[0], abs=1e-4) and got["b"] == pytest.approx(w[1], abs=1e-4)


def test_selection_prefers_the_greatest_text_on_ties(spark):
    rows = [("s", "m", '{"C": 1.0}', 1, 0.5), ("s", "m", '{"C": 10.0}', 1, 0.5), ("s", "m", '{"C": 0.1}', 1, None)]
    df = spark.createDataFrame(rows, "feature_set string, model string, parameters string, seed int, f1 double")
    assert modelling.select_best(df).first().parameters == max(r[2] for r in rows[:2])


def test_load_checks_name_the_first_failure(spark):
    good = ("http://a.example/", "http://a.example/", 1, "s", "a.example")
    cols = "url_raw string, url_clean string, label int, source string, registered_domain string"
    analysis.require_loadable(spark.createDataFrame([good], cols))
    for bad, name in (((*good[:2], 2, *good[3:]), "label_domain"), ((good[0], "HTTP://a.example", *good[2:]), "not_normalized"), ((*good[:3], " ", good[4]), "blank_source"), ((*good[:4], "b.example"), "domain")):
        with pytest.raises(ValueError, match=name):
            analysis.require_loadable(spark.createDataFrame([bad], cols))


def _artifact(name):
    return (f"o/{name}", "a" * 64, 1, "2025-01-01T00:00:30+00:00")


def _observation(**changes):
    clean, source = "http://a.example/", "tranco"
    import hashlib

    row = {
        "schema_version": "observation-v2", "observation_id": "o1", "candidate_id": hashlib.sha256(f"{source}\n{clean}".encode()).hexdigest(), "candidate_class": 0, "source": source,
        "url_raw": "HTTP://a.example", "url_clean": clean, "domain_group": "a.example", "label": ("p", None, "assumed_benign", False, "pending", None),
        "started_at": "2025-01-01T00:00:00+00:00", "ended_at": "2025-01-01T00:01:00+00:00", "status": "complete", "reason": None, "final_url": None, "http_status": 200,
        "navigation_chain": [], "modalities": tuple(map(_artifact, ("url", "dom", "shot", "net"))), "capture_duration_ms": 1.0, "readiness_pass": True, "capture_evidence": (_artifact("r"), _artifact("s")),
    }
    return tuple((row | changes).values())


def test_observation_violations(spark):
    cases = {
        None: {},
        "url_not_normal_form": {"url_raw": "http://b.example/"},
        "group_differs": {"domain_group": "x"},
        "candidate_id_differs": {"candidate_id": "0"},
        "ends_before_start": {"ended_at": "2024-01-01T00:00:00+00:00"},
        "label_assigned_at_capture": {"label": ("p", 1, "assumed_benign", False, "pending", None)},
        "modality_absent": {"modalities": (_artifact("u"), None, None, None)},
        "http_not_successful": {"http_status": 404},
        "not_ready": {"readiness_pass": False},
        "path_outside_root": {"capture_evidence": (("../x", "a" * 64, 1, "2025-01-01T00:00:30+00:00"), _artifact("s"))},
        "artifact_time_outside": {"capture_evidence": (("x", "a" * 64, 1, "2025-01-02T00:00:30+00:00"), _artifact("s"))},
    }
    for want, changes in cases.items():
        df = spark.createDataFrame([_observation(**changes)], observations.OBSERVATION)
        assert observations.record_violations(df).first().violation == want


def test_review_violations(spark):
    seen = spark.createDataFrame([_observation()], observations.OBSERVATION)
    evidence = [("o/dom", "a" * 64), ("o/shot", "a" * 64)]
    good = ("o1", "v1", "ann", "human", "2025-01-02T00:00:00+00:00", "assumed_benign", "benign", "a reason that is long enough", evidence)
    cases = [(good, None), ((*good[:5], "other", *good[6:]), "assertion_differs"), ((*good[:8], evidence[:1]), "class_without_dom_and_screenshot"),
             ((*good[:8], [("o/dom", "b")]), "evidence_differs"), ((*good[:4], "2024-01-01T00:00:00+00:00", *good[5:]), "reviewed_before_capture")]
    for row, want in cases:
        df = spark.createDataFrame([row], observations.REVIEW)
        assert observations.review_violations(df, seen, "2025-02-01").first().violation == want


def test_readiness(spark):
    state = lambda ms, sig, chars=5, ready="complete": (ms, ready, chars, 0.0, sig)
    rows = [("ok", [state(0, "a"), state(100, "a"), state(200, "a")]), ("moving", [state(0, "a"), state(1, "b"), state(2, "a")]), ("blank", [state(i, "a", 0) for i in range(5)]), ("none", [])]
    df = spark.createDataFrame(rows, "name string, states array<struct<elapsed_ms:int,ready_state:string,visible_text_chars:int,largest_visible_image_fraction:double,signature:string>>")
    assert {r.name for r in observations.readiness(df, min_wait_ms=150).filter("ready").collect()} == {"ok"}


def test_page_helpers(spark):
    html = """<A class="x" href="/a?b=1&amp;c=2">x</a><a href='b'>y</a><a href=c>z</a><a name="n">"""
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert [r.href for r in pages.links(df, "id").orderBy("position").collect()] == ["/a?b=1&c=2", "b", "c"]
    rules = "User-agent: *\nDisallow: /private\nSitemap: http://a.example/s.xml\n"
    one = spark.createDataFrame([(rules, "http://a.example/private/x", "http://a.example/y")], "t string, u string, v string")
    r = one.select(pages.robots_allows(F.col("t"), "bot", F.col("u")).alias("no"), pages.robots_allows(F.col("t"), "bot", F.col("v")).alias("yes"), pages.robots_sitemaps(F.col("t")).alias("maps"), pages.resolve(F.col("u"), F.lit("../z")).alias("joined")).first()
    assert (r.no, r.yes, r.maps, r.joined) == (False, True, ["http://a.example/s.xml"], "http://a.example/z")
    assert spark.range(1).select(pages.sitemap_locations(F.lit("<loc> http://x.example/ </loc><a:loc>y</a:loc>")).alias("l")).first().l == ["http://x.example/", "y"]


def test_stream(spark, tmp_path):
    schema = "url_raw string, seen_at timestamp"
    rows = spark.sql("SELECT * FROM VALUES ('HTTP://A.example', timestamp'2025-01-01 00:00:00'), ('http://a.example/', timestamp'2025-01-01 00:10:00'), ('bad', timestamp'2025-01-01 00:10:00') AS v(url_raw, seen_at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = cleaned_stream(spark, str(tmp_path / "in"), schema).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    assert [r.url_clean for r in spark.table("cleaned").collect()] == ["http://a.example/"]
    assert window_counts(rows, "seen_at", "url_raw").count() == 3
