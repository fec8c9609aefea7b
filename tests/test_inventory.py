import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlloom.functions import features, suffixes, urls
from urlloom.operators import analysis, draws, experiment, observations, prepare, split
from urlloom.sources import feeds


def _files(tmp_path):
    (tmp_path / "p.csv").write_text("﻿phish_id,url\n1,HTTP://A.example:80/x#f\n2,http://b.example/\n3,\n4,\"http://q.example/a\nb\"\n", encoding="utf-8")
    (tmp_path / "o.txt").write_text("﻿http://c.example/\n\nhttp://b.example/\nbad url here", encoding="utf-8")
    (tmp_path / "t.csv").write_text("rank,domain\n1,D.example\nx,e.example\n3,b.example\n", encoding="utf-8")
    return [str(tmp_path / n) for n in ("p.csv", "o.txt", "t.csv")]


def test_feeds_are_numbered_in_file_order(spark, tmp_path):
    rows = {(r.source, r.row_number): (r.url_raw, r.error) for r in feeds.read_feeds(spark, *_files(tmp_path)).collect()}
    assert rows["phishtank", 2] == ("HTTP://A.example:80/x#f", None) and rows["phishtank", 4][1] == "missing URL" and ("phishtank", 5) in rows
    assert rows["openphish", 1] == ("http://c.example/", None) and rows["openphish", 2][1] == "missing URL" and rows["openphish", 4][0] == "bad url here"
    assert rows["tranco", 2] == ("https://D.example/", None) and rows["tranco", 3][1] and len(rows) == 4 + 4 + 3


def test_numbering_spans_partitions(spark, tmp_path):
    spark.range(1000).select(F.lpad(F.col("id").cast("string"), 6, "0")).coalesce(1).write.text(str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = feeds.numbered_lines(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(int(r.line) + 1 == r.number for r in rows) and len(rows) == 1000


def test_ranked_candidates_draw_like_the_generator(spark, tmp_path):
    (tmp_path / "r.csv").write_text("\n".join(f"{i},D{i}.example" for i in range(1, 31)))
    got = sorted(tuple(r) for r in feeds.ranked_candidates(spark, str(tmp_path / "r.csv"), 5, 25, 10, seed=3).collect())
    assert got == sorted(random.Random(3).sample([(i, f"d{i}.example") for i in range(5, 26)], 10))
    with pytest.raises(ValueError):
        feeds.ranked_candidates(spark, str(tmp_path / "r.csv"), 5, 25, 40)


def _rows(spark):
    rows = [("phishtank", 1, i, f"http://p{i}.example/{i % 2}", None) for i in range(30)] + [("tranco", 0, i, f"https://l{i}.example/", None) for i in range(25)]
    rows += [("phishtank", 1, 90, "http://p1.example/1", None), ("tranco", 0, 91, "http://p2.example/0", None), ("tranco", 0, 92, "nope", None)]
    return spark.createDataFrame(rows, "source string, label int, row_number long, url_raw string, error string")


def test_outputs_round_trip(spark, tmp_path):
    made = prepare.balance(prepare.dispositions(_rows(spark)), 10, 7, "hash")
    folder = str(tmp_path / "out")
    manifest = prepare.write_outputs(made, folder, 10, 7)
    back = prepare.read_table(spark, folder, "urls", "url_raw string, url_clean string, label int, source string, registered_domain string")
    assert Counter(r.label for r in back.collect()) == {0: 10, 1: 10}
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out/urls").glob("*.csv")))
    assert manifest["dataset_sha256"] == hashlib.sha256(data).hexdigest()
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"urls", "cleaning_summary", "source_summary", "rejected_records", "conflicting_labels", "sampling_manifest"}
    assert feeds.checksum_manifest(spark, folder).count() > 5
    with pytest.raises(Exception, match="exist"):
        prepare.write_outputs(made, folder, 10, 7)
    one = str(tmp_path / "one")
    feeds.write_csv(back, one, feeds.DATASET)
    assert feeds.read_dataset(spark, one).count() == 20


def test_supplement_gates(spark):
    rows = spark.createDataFrame([("http://a/1", "a"), ("http://a/2", "a"), ("http://b/1", "b")], "url_clean string, registered_domain string")
    more = spark.createDataFrame([("http://c/1", "c"), ("http://c/1", "c")], rows.schema)
    merged, provenance = prepare.merge_supplement(rows, more)
    assert merged.count() == 4 and sorted((r.batch, r.retained) for r in provenance.collect()) == [("original", True)] * 3 + [("supplement", False), ("supplement", True)]
    for bad in (rows.withColumn("x", F.lit(1)), rows.limit(1), spark.createDataFrame([(f"http://d/{i}", "d") for i in range(4)], rows.schema)):
        with pytest.raises(ValueError):
            prepare.merge_supplement(rows, bad)


def test_take_smallest_equals_a_sort(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("int").alias("c"), F.col("id").cast("string").alias("v"))
    limits = spark.createDataFrame([(0, 17), (1, 5000), (2, 0)], "c int, k int")
    got = draws.take_smallest(rows, ["c"], F.sha2("v", 256), ["v"], limits).collect()
    want = {(0, v) for v in sorted((str(i) for i in range(0, 5000, 3)), key=lambda v: hashlib.sha256(v.encode()).hexdigest())[:17]} | {(1, str(i)) for i in range(1, 5000, 3)}
    assert {(r.c, r.v) for r in got} == want and len(got) == len(want)


def test_positions_run_through_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 7 % 2).cast("int").alias("c"), F.sha1(F.col("id").cast("string")).alias("v"), F.lit(1).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = draws.positioned(rows.repartition(9), "c", ["v"], "pos").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in got}) > 3
    for c in (0, 1):
        want = sorted(r.v for r in rows.filter(F.col("c") == c).collect())
        assert [(r.pos, r.v) for r in sorted(got, key=lambda r: r.pos) if r.c == c] == list(enumerate(want))
    assert draws.positioned(rows.limit(0), "c", ["v"]).count() == 0


def test_group_draws_and_conflicts(spark):
    rows = spark.createDataFrame([(f"g{i % 6}", f"u{i}") for i in range(30)], "registered_domain string, url_clean string")
    got = draws.group_candidates(rows, 4, 1).collect()
    assert len(got) == 4 == len({r.registered_domain for r in got})
    assert all(int(r.url_clean[1:]) % 6 == int(r.registered_domain[1:]) for r in got)
    assert draws.group_candidates(rows.repartition(5), 4, 1).exceptAll(draws.group_candidates(rows, 4, 1)).count() == 0
    controls = spark.createDataFrame([("u1",), ("zz",)], "url_clean string")
    assert [r.url_clean for r in draws.without_conflicts(controls, rows).collect()] == ["zz"]
    ranks = spark.createDataFrame([("a", 5, "x"), ("a", 2, "y"), ("b", 1, "z")], "registered_domain string, rank int, domain string")
    assert [tuple(r) for r in draws.best_ranks(ranks, rows.selectExpr("'b' AS registered_domain")).collect()] == [("a", 2, "y")]


@pytest.mark.parametrize("n", [40, 900])
def test_group_search_by_hash_equals_sorting(spark, n):
    rng = random.Random(n)
    rows = [(f"g{rng.randrange(n)}", rng.randrange(2)) for _ in range(n * 3)]
    df = spark.createDataFrame(rows, "domain_group string, label int")
    size, positive = Counter(g for g, _ in rows), Counter(g for g, y in rows if y)
    scored = []
    for t in range(30):
        held = pos = 0
        taken = []
        for g in sorted(size, key=lambda g, t=t: (hashlib.md5(f"4:{t}:{g}".encode()).hexdigest(), g)):
            if held >= len(rows) * 0.15:
                break
            taken.append(g)
            held, pos = held + size[g], pos + positive[g]
        scored.append((round(abs(held / len(rows) - 0.15) + abs(pos / held - sum(positive.values()) / len(rows)), 12), t, set(taken)))
    assert {r.grp for r in split.choose_groups_by_hash(df, 0.15, 4, trials=30).collect()} == min(scored, key=lambda x: x[:2])[2]


def test_random_split_keeps_the_test_rows(spark):
    rows = [(f"u{i}", f"g{i // 4}", i % 2, "test" if i < 60 else "validation" if i < 130 else "train") for i in range(400)]
    df = spark.createDataFrame(rows, "url_clean string, domain_group string, label int, split string")
    got = {r.url_clean: r.split for r in split.random_split(df, 5).collect()}
    assert {u for u, s in got.items() if s == "test"} == {r[0] for r in rows[:60]}
    per_class = round(170 * split.VALIDATION)
    assert Counter((int(u[1:]) % 2) for u, s in got.items() if s == "validation") == {0: per_class, 1: per_class}
    both = {r.split_strategy: r for r in split.compare_splits(df, 5).collect()}
    assert both["grouped"].domain_overlap_count <= 1 < both["random_url"].domain_overlap_count
    manifest = df.select(F.col("url_clean").alias("sample_id"), "split")
    given = df.withColumn("sample_id", F.col("url_clean"))
    assert split.with_manifest(given, manifest).count() == 400
    for bad in (manifest.limit(399), manifest.unionByName(manifest.limit(1))):
        with pytest.raises(ValueError):
            split.with_manifest(given, bad)


def test_errors_and_importances(spark):
    df = spark.createDataFrame([("m", "s1", "g", 1, 0.4), ("m", "s2", "g", 1, 0.1), ("m", "s3", "h", 0, 0.9), ("m", "s4", "h", 0, 0.2)], "model string, sample_id string, domain_group string, label int, score double")
    assert [(r.sample_id, r.position) for r in split.top_errors(df, ["model", "label"], 1).orderBy("label").collect()] == [("s3", 1), ("s2", 1)]
    assert [(r.label, r.domain_group, r.error_count) for r in split.errors_by_group(df, ["model"]).collect()] == [(1, "g", 2), (0, "h", 1)]
    imp = spark.createDataFrame([("m", f"f{i}", i / 10) for i in range(9)], "model string, feature string, importance double")
    assert [r.feature for r in split.top_importances(imp, 2).orderBy("position").collect()] == ["f8", "f7"]


def _rules(n):
    plain = [f"s{i}.cc{i % 50}" for i in range(n)] + [f"cc{i}" for i in range(50)] + ["uk", "co.uk", "jp", "ck"]
    return suffixes.SuffixRules.of([*plain, "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp"])


def test_large_rule_tables_give_the_same_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.test", "a.b.c.ck", "b.ck", "www.ck", "a.www.ck", "x.y.kawasaki.jp", "kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp", "a.s7.cc7", "s7.cc7", "s8.cc7", "z.s8.cc7", "192.0.2.1"]
    df = spark.createDataFrame([(f"http://{h}/",) for h in [*hosts, *hosts, "bad_host"]], "url_raw string")
    small, large = (urls.with_clean_urls(df, rules=_rules(n)).select("url_raw", "registered_domain") for n in (100, 7000))
    assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)
    got = {r.url_raw[7:-1]: r.registered_domain for r in large.collect()}
    assert (got["a.b.c.ck"], got["www.ck"], got["a.city.kawasaki.jp"], got["a.s7.cc7"], got["192.0.2.1"]) == ("b.c.ck", "www.ck", "city.kawasaki.jp", "a.s7.cc7", "192.0.2.1")


def test_aligned_features(spark):
    df = spark.createDataFrame([({"url_length": 3.0, "dot_count": 1.0},), ({"url_length": float("nan")},), ({"url_length": float("inf")},), ({"url_length": 1.0, "colour": 2.0},)], "features map<string,double>")
    strict = [(r.url_length, r.problem) for r in features.aligned(df, ["url_length"]).collect()]
    assert strict == [(3.0, None), (None, "missing: url_length"), (float("inf"), "not finite: url_length"), (1.0, "unknown: colour")]
    assert [r.problem for r in features.aligned(df, ["url_length"], allow_missing=True).collect()] == [None, None, "not finite: url_length", "unknown: colour"]


def test_url_policies(spark):
    df = spark.createDataFrame([("http://8.8.8.8/", "8.8.8.8"), ("http://10.0.0.1/", "10.0.0.1"), ("http://[::1]/", "::1"), ("https://a.example:8443/", "a.example")], "url_raw string, h string")
    parts = urls.with_clean_urls(df)
    assert [r.p for r in df.limit(3).select(urls.public_ip_column(F.col("h")).alias("p")).collect()] == [True, False, False]
    assert urls.destination_policy(parts).count() == 4
    assert spark.range(1).select(urls.site_url(F.lit(" A.example "))).first()[0] == "https://a.example/"


def test_suitability_and_structure(spark):
    rows = [("http://a.example/", "u"), ("https://a.example/x?q=1", "u"), ("https://b.example/y", "v")]
    df = urls.with_clean_urls(spark.createDataFrame(rows, "url_raw string, observed_from string")).withColumn("domain_group", F.col("host"))
    r = analysis.suitability(df, urls=2, domains=2).first()
    assert (r.decision, r.reasons, r.urls, r.domains, r.normalized_duplicates) == ("suitable_for_bounded_baseline_with_caveats", [], 3, 2, 0)
    assert analysis.suitability(df).first().reasons == ["too_few_urls", "too_few_domains"]
    assert analysis.suitability(df.filter("false")).first().reasons == ["too_few_urls", "too_few_domains", "inner_page_rate"]
    assert {r.observed_from: (r.url_count, r.domain_count) for r in analysis.structure_summary(df).collect()} == {"u": (2, 1), "v": (1, 1)}


def test_evidence_and_reviews(spark, tmp_path):
    (tmp_path / "o").mkdir()
    for name, body in {"robots": {"allowed": False, "hops": [{"body": {"path": "o/b", "sha256": "0", "size_bytes": 1, "captured_at": "2025-01-01T00:00:00+00:00"}}]}, "ready": {"passed": False}, "url": {"observation_id": "x"}}.items():
        (tmp_path / f"o/{name}.json").write_text(json.dumps(body))
    art = lambda n: {"path": f"o/{n}.json", "sha256": "0", "size_bytes": 1, "captured_at": "2025-01-01T00:00:00+00:00"}
    record = {"observation_id": "id", "status": "complete", "readiness_pass": True, "started_at": "a", "ended_at": "b", "modalities": {"url": art("url")}, "capture_evidence": {"robots": art("robots"), "readiness": art("ready")}}
    (tmp_path / "obs" / "one").mkdir(parents=True)
    (tmp_path / "obs/one/observation.json").write_text(json.dumps(record, indent=1))
    rows = observations.read_observations(spark, str(tmp_path / "obs"))
    assert {(r.name, r.violation) for r in observations.evidence_violations(rows, str(tmp_path)).collect()} == {("robots", "robots_not_allowed"), ("readiness", "readiness_differs"), ("url", "modality_of_other_observation")}
    assert [r.path for r in observations.hop_bodies(rows, str(tmp_path)).collect()] == ["o/b"]
    assert {r.violation for r in observations.file_violations(rows, str(tmp_path)).collect()} == {"artifact_bytes_differ"}
    review = {"observation_id": "id", "decision": "benign", "reason": "größer"}
    good = observations.review_identity(review)
    (tmp_path / "rev").mkdir()
    (tmp_path / f"rev/{good}.json").write_text(json.dumps(review, indent=2))
    (tmp_path / "rev/other.json").write_text(json.dumps(review))
    assert [(r.review_id, r.expected) for r in observations.review_id_violations(spark, str(tmp_path / "rev")).collect()] == [("other", good)]
    assert {r.review_id for r in observations.read_reviews(spark, str(tmp_path / "rev")).collect()} == {good, "other"}
    table = str(tmp_path / "table")
    new = spark.createDataFrame([("a", "1"), ("b", "2")], "review_id string, value string")
    assert observations.write_reviews(new, table).count() == 2 and observations.write_reviews(new, table).count() == 0
    with pytest.raises(ValueError):
        observations.write_reviews(new.withColumn("value", F.lit("9")), table)
    counts = {(r.status, r.reason): r["count"] for r in observations.status_counts(rows.withColumn("candidate_class", F.lit(0))).collect()}
    assert counts == {("complete", None): 1}


def test_freshness(spark):
    rows = spark.createDataFrame([("2025-01-01T00:00:00Z",), ("2025-01-02T06:00:00+00:00",), ("2024-12-01T00:00:00Z",), ("x",)], "t string")
    fresh = observations.is_fresh(F.col("t"), F.lit("2025-01-02T00:00:00Z"), 24)
    assert [r[0] for r in rows.select(fresh).collect()] == [True, False, False, False]


def test_seeds_of_diagnostics():
    from urlloom.functions.seeds import derive_seed

    assert experiment._SIZE_PURPOSE.format(7, 0.5) == "assignment03:size:7:0.5000"
    assert derive_seed(42, experiment._MODEL_PURPOSE.format(0)) == int(hashlib.sha256(b"url-seeds-v1:42:model_sensitivity:0").hexdigest()[:8], 16)


def test_pilot_decision_and_latency(spark):
    rows = spark.createDataFrame([], observations.OBSERVATION)
    plan = spark.createDataFrame([("c", "u", 0, "s")], "candidate_id string, url_clean string, candidate_class int, source string")
    labels = spark.createDataFrame([], "status string, project_label int")
    got = observations.pilot_decision(rows, plan, labels, preflight=True, required=1, per_class=0).first()
    assert (got.decision, got.planned, got.recorded, got.off_plan) == ("pilot_incomplete", 1, 0, 1)
    timed = experiment.latency(lambda b: b, [spark.range(10)], 1, 3)
    assert timed[0]["batch_size"] == 10 and timed[0]["p95_ms_per_url"] >= timed[0]["median_ms_per_url"] > 0
