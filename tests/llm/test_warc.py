import base64
import hashlib
import random

import pytest

from urlloom.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    odd = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a.example/x", "same"), (2, "http://b.example/y", "same"), (9, "HTTPS://www.A.example:443/x?q=1", "same"), (3, None, None), (4, "http://a.example/\r\nX: 1", ""), (5, "http://a.example/x", odd), (6, "http://[bad", "ünï"), (9, "http://a.example/x", "same"), (7, "u" * 3000, "x" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "1 AS bytes")
    found = warc.capture_histories(pages, str(tmp_path / "w"), archive_bytes=40_000)
    got = {(r.page_id, r.url): r for r in found.collect()}
    assert len(got) == len(rows)
    kept = {}
    for i, _, t in rows:
        kept[t or ""] = max(kept.get(t or "", -1), i)
    for (i, _), r in got.items():
        t = next(t for j, _, t in rows if j == i)
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), digest(t))
        assert (r.record_type, r.refers_to) == (("response", None) if kept[t or ""] == i else ("revisit", kept[t or ""]))


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb"), (None, "u", "bbbb")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), min_payload=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.index_runs(spark, str(tmp_path / "w")).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 4)}


def test_histories_are_globally_ordered(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/{i % 3}", f"page {i}") for i in range(600)]
    found = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), archive_bytes=30_000)
    rows = sorted(found.collect(), key=lambda r: r.position)
    keys = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(1, 601))


def test_entries_address_members_of_the_files(spark, tmp_path):
    rows = [(i, f"http://h{i % 5}.example/", f"page {i} " * (i % 40)) for i in range(400)] + [(900, "http://h.example/", "long text " * 300_000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(found) == 401
    for r in found:
        data = (tmp_path / "w" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        _, _, headers, _ = warc.read_record(data)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"


def test_capture_numbers_run_through_ranges(spark, tmp_path):
    rows = [(i, "http://a.example/" if i % 3 else "http://b.example/", f"{i}") for i in range(600)]
    found = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()
    for key in ("example,a)/", "example,b)/"):
        mine = sorted((r.page_id, r.capture_no) for r in found if r.url_key == key)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1)) and len(mine) in (200, 400)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_histories(pages, str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(n):
    rng = random.Random(n)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(n)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_damage_is_found():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert len(list(warc.read_records(record * 2))) == 2
    with pytest.raises(ValueError):
        list(warc.read_records(record.replace(b"5", b"4")))


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == ""
