import random

import duckdb
import oracle
import pytest

from urlloom.plans import catalogue, duck, sql

NAME = "q53_dataset_audit"


def audited(spark):
    return catalogue.QUERIES[NAME], catalogue.ORACLE_SQL[NAME]


def test_distinct_entropies_are_those_of_the_sql(spark):
    assert oracle.compare(spark, *audited(spark), "/root/testdata/sf0.1") is None


@pytest.mark.parametrize("alphabet", [90, 400, 20000])
def test_order_and_bits(alphabet):
    """Through several sizes of the table, with characters of one to three bytes."""
    rng = random.Random(alphabet)
    texts = ["".join(chr(33 + rng.randrange(alphabet)) for _ in range(rng.choice([1, 13, 14, 30, 60, 300, 3000]))) for _ in range(60)]
    con = duckdb.connect()
    order = dict(con.execute("SELECT t, list_distinct(list_transform(range(1, len(t) + 1), lambda i: substring(t, i, 1))) FROM unnest(?) u(t)", [texts]).fetchall())
    assert all(duck.distinct_order(dict.fromkeys(t)) == order[t] for t in texts)
    if alphabet == 90:
        url = "(SELECT t AS url_clean, '' AS host, '' AS path, '' AS query, '' AS scheme, '' AS registered_domain, false AS is_ip, 1 AS port FROM unnest(?) u(t))"
        bits = dict(con.execute(f"SELECT url_clean, url_entropy FROM (SELECT *, {sql.FEATURES} FROM {url})", [texts]).fetchall())
        assert all(duck.shannon(t) == bits[t] for t in texts)


def test_small_and_halved_rates(spark, tmp_path, monkeypatch):
    """Rates below 0.001 and 0.0001, and 41 of 640, which is half a millionth from the next."""
    scheme = {0: 41, 1: 5, 2: 1}
    size = {0: 640, 1: 20000, 2: 40000}
    rows = [(3 * i + s, f"{'https' if i < scheme[s] else 'http'}://a.example.com/x") for s in size for i in range(size[s])]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.execute("INSERT INTO pages SELECT unnest(?), unnest(?)", [[r[0] for r in rows], [r[1] for r in rows]])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    con.execute(f"COPY (SELECT page_id AS doc_id, 1 AS quality, 0 AS toxic FROM pages) TO '{tmp_path}/labels.parquet'")
    monkeypatch.setattr(oracle, "TABLES", ["pages", "labels"])
    query, text = audited(spark)
    assert oracle.compare(spark, query, text, str(tmp_path)) is None
    rates = {r.key: r.value for r in query(spark, str(tmp_path)).filter("section = 'https_rate'").collect()}
    assert rates == {"src0|1": "0.064062", "src1|1": "0.00025", "src2|1": "2.5e-05"}
