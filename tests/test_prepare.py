import random

import pytest
from pyspark.sql import functions as F

from urlloom.functions.seeds import derive_seed, draw_positions, load_plan, make_plan, write_plan
from urlloom.operators import prepare
from urlloom.sources import feeds

CSV = "phish_id,url\n1,HTTP://Login.Site.Example:80/a#x\n2,http://shared.example/\n3,\n4,not a url\n5,https://ranked.example/\n6,http://plain.example/\n"
LINES = "http://open.example/p\nhttp://shared.example/\nHTTP://SHARED.example:80/#frag\n\nhttp://bad host/\n"
RANKED = "rank,domain\n1,good.example\n2,fine.example\n3,ranked.example\n4,nice.example\nx,odd.example\n"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("feeds")
    for name, text in (("a.csv", "﻿" + CSV), ("b.txt", LINES), ("c.csv", RANKED)):
        (d / name).write_text(text, encoding="utf-8")
    return feeds.read_feeds(spark, str(d / "a.csv"), str(d / "b.txt"), str(d / "c.csv")).cache()


def test_rows_and_numbers(feed):
    got = {(r.source, r.row_number): (r.url_raw, r.error) for r in feed.collect()}
    assert len(got) == 16
    assert got["phishtank", 2] == ("HTTP://Login.Site.Example:80/a#x", None)
    assert got["phishtank", 4] == (None, "missing URL")
    assert got["openphish", 4] == (None, "missing URL")
    assert got["tranco", 2] == ("https://good.example/", None)
    assert got["tranco", 6] == (None, "expected numeric rank and domain")


def test_counters(feed):
    made = prepare.balance(prepare.dispositions(feed), 2, 42, "parity").cache()
    total = {r.source: r for r in prepare.cleaning_summary(made).collect()}["total"]
    assert total.asDict() == {
        "source": "total", "raw_records": 16, "accepted_records": 4, "invalid_or_rejected_records": 12, "invalid_records": 5, "exact_duplicates": 1, "normalized_duplicates": 1,
        "conflicting_label_records": 2, "final_phishing": 2, "final_legitimate": 2, "unique_registered_domains": 4,
    }
    accepted = {(r.source, r.label): r.accepted_before_sampling for r in prepare.source_summary(made).collect()}
    assert accepted == {("phishtank", 1): 3, ("openphish", 1): 1, ("tranco", 0): 3}
    conflict = prepare.conflicts(made).collect()
    assert [(r.url_clean, r.labels, r.sources, r.record_count) for r in conflict] == [("https://ranked.example/", "0;1", "phishtank;tranco", 2)]
    manifest = prepare.sampling_manifest(made, 2, 42)
    assert manifest["candidate_counts"] == {"0": 3, "1": 4} and not manifest["shortfall"]


def test_order_does_not_matter(feed):
    a = prepare.balance(prepare.dispositions(feed), 2, 7)
    b = prepare.balance(prepare.dispositions(feed.orderBy(F.rand(3)).repartition(5)), 2, 7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_first_row_in_input_order(spark):
    rows = [("z", 1, 1, "http://a.example/#1"), ("a", 1, 2, "http://a.example/"), ("a", 1, 3, "http://a.example/#1")]
    d = spark.createDataFrame([(*r, None) for r in rows], feeds.PARSED)
    got = {r.row_number: r.reason for r in prepare.dispositions(d, order=prepare.BY_INPUT).collect()}
    assert got == {1: None, 2: "normalized_duplicate", 3: "exact_duplicate"}


def test_labels_must_be_integers(spark):
    with pytest.raises(ValueError):
        prepare.dispositions(spark.createDataFrame([("a", True, 1, "http://a.example/", None)], "source string, label boolean, row_number bigint, url_raw string, error string"))


def test_json_feeds(spark, tmp_path):
    for name, text in (("a", '{"data": [{"url": "http://a.example/"}, {"x": 1}, "http://b.example/"]}'), ("b", '["http://a.example/", null]'), ("c", '{"x": 1}')):
        (tmp_path / f"{name}.json").write_text(text)
    got = [(r.row_number, r.url_raw, r.error) for r in feeds.phishtank(spark, str(tmp_path / "a.json")).orderBy("row_number").collect()]
    assert got == [(1, "http://a.example/", None), (2, None, "missing URL"), (3, "http://b.example/", None)]
    assert [r.error for r in feeds.phishtank(spark, str(tmp_path / "b.json")).orderBy("row_number").collect()] == [None, "missing URL"]
    with pytest.raises(ValueError):
        feeds.phishtank(spark, str(tmp_path / "c.json"))
    with pytest.raises(ValueError):
        feeds.phishtank(spark, str(tmp_path / "c.xml"))


def test_pinned_array(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('["http://a.example/", "x"]')
    assert feeds.pinned_json_array(spark, str(p), feeds.sha256_file(str(p)), "h", 0).count() == 2
    with pytest.raises(ValueError):
        feeds.pinned_json_array(spark, str(p), "0" * 64, "h", 0)


def test_ranked_range(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("".join(f"{i},D{i}.example\n" for i in range(1, 31)))
    assert [r.domain for r in feeds.ranked_candidates(spark, str(p), 5, 7, 3).orderBy("rank").collect()] == ["d5.example", "d6.example", "d7.example"]
    with pytest.raises(ValueError):
        feeds.ranked_candidates(spark, str(p), 5, 7, 10)


def test_seeds(tmp_path):
    assert draw_positions(5, 100, 10) == sorted(random.Random(5).sample(range(100), 10))
    assert derive_seed(42, "test") != derive_seed(42, "model")
    with pytest.raises(ValueError):
        derive_seed(-1, "x")
    write_plan(str(tmp_path / "p"), make_plan(42))
    assert load_plan(str(tmp_path / "p"))["master_seed"] == 42
    with pytest.raises(FileExistsError):
        write_plan(str(tmp_path / "p"), make_plan(42))
