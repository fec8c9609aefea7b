import ipaddress
import re
from urllib.parse import urlsplit

import pytest

from urlloom.functions import features, suffixes, urls

CASES = """HTTPS://EXAMPLE.com:443/Path?b=2&a=1#frag
http://example.com:80|http://example.com:8080/|http://example.com:00080/x|http://example.com:0/|http://example.com:/|http://example.com:70000/
http://example.com:8a/|example.com/no-scheme|ftp://example.com/|http://exa mple.com/|http:///path|http://|https://?q|http://a..b/|http://.a.b/
http://under_score.example.com/|http://trailing.example.com./|http://-a.example/|http://a-.example/|http://192.168.1.1/a|http://192.168.001.1/
http://256.1.1.1/|http://[2001:db8::1]/x|http://[2001:db8::1]:8080/|http://[::ffff:192.0.2.1]/|http://[2001:db8::1/|http://2001:db8::1]/
http://[1:2:3:4:5:6:7]/|http://[1:2:3:4:5:6:7:8]/|http://[1:2:3:4:5:6:7:8:9]/|http://user:pw@example.com/
http://user@host@example.com/|http://@example.com/|http://example.com?x=1|http://example.com/?|http://example.com/#|http://exämple.com/ü?ö
http://faß.de/|http://a。b/|https://localhost/|https://xn--exmple-cua.com/|http://1.2.3.4:443/|https://1.2.3.4:80/|//example.com/|http:example.com
http://example.com/a|b{c}|http://example.com/%zz%41|hTTp://ExAmPlE.CoM/AbC|http://a.b.example.co.uk/login?account=1
http://host12.example:8443/a%20b?token=3|http://bank-update.example.org/secure/signin.php?verify=1&confirm=2""".replace("\n", "|").split("|")
CASES += ["", "   ", "  http://example.com/  ", "http://example.com/\x7f", "http://ex\tample.com/", "http://" + "a" * 64 + ".com/", "http://" + "a." * 130 + "com/", None]


def clean(value):
    if value is None:
        return urls.NOT_STRING, None
    value = value.strip()
    if not value or re.search(r"[\s\x00-\x1f\x7f]", value):
        return urls.BLANK, None
    try:
        parts = urlsplit(value)
        port = parts.port
    except ValueError:
        return urls.MALFORMED, None
    if parts.scheme not in ("http", "https"):
        return urls.SCHEME, None
    if not parts.hostname:
        return urls.NO_HOST, None
    try:
        host = parts.hostname.encode("idna").decode().lower()
    except UnicodeError:
        return urls.NOT_IDNA, None
    try:
        v6 = ipaddress.ip_address(host).version == 6
    except ValueError:
        v6 = False
        if len(host) > 253 or not all(re.fullmatch(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?", x) for x in host.split(".")):
            return urls.BAD_LABEL, None
    shown = f"[{host}]" if v6 else host
    if port is not None and port != {"http": 80, "https": 443}[parts.scheme]:
        shown += f":{port}"
    if "@" in parts.netloc:
        shown = parts.netloc.rpartition("@")[0] + "@" + shown
    return None, f"{parts.scheme}://{shown}{parts.path or '/'}{'?' + parts.query if parts.query else ''}"


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, url_raw string")
    found = features.with_features(urls.with_clean_urls(rows), "expanded21").collect()
    return {r.i: r for r in found}


def test_clean_equals_the_standard_library(cleaned):
    wrong = [(c, (cleaned[i].reason, cleaned[i].url_clean), clean(c)) for i, c in enumerate(CASES) if (cleaned[i].reason, cleaned[i].url_clean) != clean(c)]
    assert not wrong


def test_features(cleaned):
    r = cleaned[CASES.index("http://host12.example:8443/a%20b?token=3")]
    assert (r.hostname_digit_ratio, r.percent_encoded_count, r.has_nondefault_port) == (2 / 14, 1, 1)
    r = cleaned[CASES.index("http://bank-update.example.org/secure/signin.php?verify=1&confirm=2")]
    assert (r.suspicious_keyword_count, r.equals_count, r.ampersand_count, r.subdomain_count, r.uses_https) == (6, 2, 1, 1, 0)
    assert cleaned[CASES.index("http://[2001:db8::1]/x")].is_ip_hostname == 1
    for i, c in enumerate(CASES):
        u = cleaned[i].url_clean
        if u:
            assert cleaned[i].url_length == len(u)
            assert cleaned[i].digit_count == sum(x.isdecimal() for x in u)
            assert cleaned[i].hostname_length == len(urlsplit(u).hostname)


def test_registered_domain(spark):
    from pyspark.sql import functions as F

    cases = {
        "a.b.example.co.uk": "example.co.uk",
        "co.uk": "co.uk",
        "example.com": "example.com",
        "a.b.test": "a.b.test",
        "x.y.foo.ck": "y.foo.ck",
        "www.ck": "www.ck",
        "a.www.ck": "www.ck",
        "a.b.kawasaki.jp": "a.b.kawasaki.jp",
        "x.city.kawasaki.jp": "city.kawasaki.jp",
        "localhost": "localhost",
    }
    df = spark.createDataFrame(list(cases.items()), "h string, d string")
    got = df.select("h", "d", urls.registered_domain(F.col("h"), F.lit(False)).alias("g"))
    assert [r for r in got.collect() if r.d != r.g] == []


def test_rule_file(tmp_path):
    p = tmp_path / "rules"
    p.write_text("// ===BEGIN ICANN DOMAINS===\ncom\n*.ck\n!www.ck\n中国\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n// ===END PRIVATE DOMAINS===\n")
    r = suffixes.read_rules(str(p))
    assert r.plain == {"com", "中国", "xn--fiqs8s"} and r.wildcard_parents == {"ck"} and r.exceptions == {"www.ck"}
    assert "github.io" in suffixes.read_rules(str(p), private=True).plain


def test_policies(spark):
    rows = [
        ("http://example.com/?sessionid=1", "example.com", "sensitive_query_key", "sensitive_query_key"),
        ("http://example.com/?my%54oken=1", "example.com", "sensitive_query_key", "sensitive_query_key"),
        ("http://u@example.com/", "example.com", "credentials_in_url", "credentials_in_url"),
        ("http://@example.com/", "example.com", None, "credentials_in_url"),
        ("http://example.com:8080/", "example.com", None, "disallowed_port"),
        ("http://example.org/", "example.com", "cross_domain", "cross_domain"),
        ("ftp://example.org/", "example.com", f"invalid_url:{urls.SCHEME}", f"invalid_url:{urls.SCHEME}"),
        ("http://example.com/a?b=c", "example.com", None, None),
    ]
    df = urls.with_clean_urls(spark.createDataFrame(rows, "url_raw string, domain_group string, page string, capture string"))
    for name, policy in (("page", urls.page_policy), ("capture", urls.capture_policy)):
        assert [(r.url_raw, r[name], r.decision) for r in policy(df).collect() if r[name] != r.decision] == []


@pytest.mark.parametrize("ip", ["127.0.0.1", "10.0.0.1", "::1", "::ffff:127.0.0.1", "224.0.0.1", "0.0.0.0", "169.254.1.1"])
def test_non_public(ip):
    assert not urls.is_public_ip(ip)


@pytest.mark.parametrize("names", ["", "url_length,url_length", "label", "nope"])
def test_bad_feature_sets(names):
    with pytest.raises(ValueError):
        features.resolve(names)
