"""URL validation, normalisation and registered domains as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlloom.functions.suffixes import DEFAULT_RULES, SuffixRules

#: The reasons for a rejection, which reports count by.
NOT_STRING = "URL must be a string"
BLANK = "URL is empty or contains whitespace/control characters"
MALFORMED = "malformed URL"
SCHEME = "only http and https schemes are accepted"
NO_HOST = "URL must contain a hostname"
NOT_IDNA = "hostname cannot be encoded with IDNA"
BAD_LABEL = "hostname contains an invalid DNS label"

_SPLIT = r"^(?:([^:/?#]+):)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _ipv6() -> str:
    """All spellings of an address: n groups, a gap, up to 7 - n groups; the last two can be dotted."""
    g = "[0-9a-fA-F]{1,4}"
    tail = f"(?:{g}:{g}|{IPV4})"
    forms = [f"(?:{g}:){{6}}{tail}"]
    for before in range(8):
        head = f"(?:{g}(?::{g}){{{before - 1}}})" if before else ""
        after = 7 - before
        rests = [""]
        if after >= 1:
            rests.append(f"{g}(?::{g}){{0,{after - 1}}}")
        if after >= 2:
            rests.append(f"(?:{g}:){{0,{after - 2}}}{IPV4}")
        forms.append(f"{head}::(?:{'|'.join(rests)})")
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


IPV6 = _ipv6()
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without white space at the ends, as Unicode sees it."""
    return F.regexp_replace(c, _STRIP, "")


def with_url_parts(df: DataFrame, url: str = "url_raw", prefix: str = "") -> DataFrame:
    """Adds the parts of the normalised URL: reason, url_clean, scheme, host, port, path, query, is_ip.

    ``reason`` tells why a URL is rejected (first failing step) and is null for valid ones;
    the other columns are null if there is a reason. Nothing is visited.
    """
    p = prefix
    names = df.columns
    s, n = "_u_text", lambda x: f"_u_{x}"
    d = df.withColumn(s, strip(F.col(url)))
    part = lambda i: F.regexp_extract(s, _SPLIT, i)
    d = d.select(*names, s, F.lower(part(1)).alias(n("scheme")), part(3).alias(n("netloc")), part(4).alias(n("path")), part(5).alias(n("query")))
    d = d.withColumn(n("info"), F.regexp_extract(n("netloc"), r"([^@]*)$", 1))
    bracketed = F.col(n("netloc")).contains("[") | F.col(n("netloc")).contains("]")
    well = F.col(n("info")).rlike(rf"^\[(?:{IPV6}|[vV][0-9a-fA-F]+\..+)\](?::.*)?$")
    d = d.withColumn(n("bracketed"), bracketed).withColumn(n("well"), well | ~bracketed)
    d = d.withColumn(
        n("host"), F.lower(F.when(F.col(n("bracketed")), F.regexp_extract(n("info"), r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(n("info"), r"^([^:]*)", 1)))
    ).withColumn(n("ptext"), F.when(F.col(n("bracketed")), F.regexp_extract(n("info"), r"\]:(.*)$", 1)).otherwise(F.regexp_extract(n("info"), r"^[^:]*:(.*)$", 1)))
    d = d.withColumn(n("pnum"), F.when(F.col(n("ptext")).rlike(r"^\d+$"), F.expr(f"try_cast({n('ptext')} as bigint)")))
    bad_port = (F.col(n("ptext")) != "") & (F.col(n("pnum")).isNull() | (F.col(n("pnum")) > 65535))
    plain = F.col(n("host")).rlike(r"^[\x00-\x7f]*$")
    ascii_ok = ~F.col(n("host")).rlike(r"^\.|\.\.|[^.]{64}")
    d = d.withColumn(
        n("ascii"), F.when(plain, F.when(ascii_ok, F.col(n("host")))).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), n("host"))))
    ).withColumn(n("ip"), F.col(n("ascii")).rlike(rf"^(?:{IPV4}|{IPV6})$"))
    bad_label = ~F.col(n("ip")) & ((F.length(n("ascii")) > 253) | ~F.col(n("ascii")).rlike(rf"^{_LABEL}(?:\.{_LABEL})*$"))
    reason = (
        F.when(F.col(url).isNull(), NOT_STRING)
        .when((F.col(s) == "") | F.col(s).rlike(r"(?U)[\s\x00-\x1f\x7f]"), BLANK)
        .when(~F.col(n("well")) | bad_port, MALFORMED)
        .when(~F.col(n("scheme")).isin("http", "https"), SCHEME)
        .when(F.col(n("host")) == "", NO_HOST)
        .when(F.col(n("ascii")).isNull(), NOT_IDNA)
        .when(bad_label, BAD_LABEL)
    )
    d = d.withColumn(f"{p}reason", reason)
    ok = F.col(f"{p}reason").isNull()
    default = ((F.col(n("scheme")) == "http") & (F.col(n("pnum")) == 80)) | ((F.col(n("scheme")) == "https") & (F.col(n("pnum")) == 443))
    d = d.withColumn(f"{p}port", F.when(ok & F.col(n("pnum")).isNotNull() & ~default, F.col(n("pnum")).cast("int")))
    user = F.when(F.col(n("netloc")).contains("@"), F.regexp_extract(n("netloc"), r"^(.*@)", 1)).otherwise("")
    shown = F.when(F.col(n("ascii")).contains(":"), F.concat(F.lit("["), F.col(n("ascii")), F.lit("]"))).otherwise(F.col(n("ascii")))
    path = F.when(F.col(n("path")) == "", "/").otherwise(F.col(n("path")))
    clean = F.concat(
        n("scheme"),
        F.lit("://"),
        user,
        shown,
        F.coalesce(F.concat(F.lit(":"), F.col(f"{p}port")), F.lit("")),
        path,
        F.when(F.col(n("query")) != "", F.concat(F.lit("?"), n("query"))).otherwise(""),
    )
    return d.select(
        *names,
        f"{p}reason",
        F.when(ok, clean).alias(f"{p}url_clean"),
        F.when(ok, F.col(n("scheme"))).alias(f"{p}scheme"),
        F.when(ok & F.col(n("netloc")).contains("@"), F.expr(f"substring({n('netloc')}, 1, length({n('netloc')}) - length({n('info')}) - 1)")).alias(f"{p}userinfo"),
        F.when(ok, F.col(n("ascii"))).alias(f"{p}host"),
        f"{p}port",
        F.when(ok, path).alias(f"{p}path"),
        F.when(ok, F.col(n("query"))).alias(f"{p}query"),
        F.when(ok, F.col(n("ip"))).alias(f"{p}is_ip"),
    )


def registered_domain(host: Column, is_ip: Column, rules: SuffixRules = DEFAULT_RULES) -> Column:
    """The public suffix and one label more; hosts without a known suffix, suffixes and IPs stay as they are."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, size - k + 1, k), ".")
    every = F.sequence(F.lit(1), size)
    matches = lambda k: last(k).isin(set(rules.plain)) | ((k > 1) & last(F.greatest(k - 1, F.lit(1))).isin(set(rules.wildcard_parents)))
    excepted = F.array_max(F.filter(every, lambda k: last(k).isin(set(rules.exceptions))))
    suffix = F.coalesce(excepted - 1, F.array_max(F.filter(every, matches)))
    return F.when(is_ip | suffix.isNull() | (suffix >= size), host).otherwise(F.array_join(F.slice(labels, size - suffix, suffix + 1), "."))


def subdomain_count(host: Column, is_ip: Column, domain: Column) -> Column:
    return F.when(is_ip, 0).otherwise(F.greatest(F.size(F.split(host, r"\.")) - F.size(F.split(domain, r"\.")), F.lit(0)))


#: More rules than this are joined by distinct host instead of being compared in an expression.
_LISTED_RULES = 500


def with_registered_domain(df: DataFrame, rules: SuffixRules, host: str = "host", is_ip: str = "is_ip") -> DataFrame:
    """``df`` with registered_domain by a rule table of any size.

    Distinct host names offer each of their endings to the broadcast rules (a public list has some ten thousand),
    and the longest suffix comes back to the rows by host. A host that holds much of the rows is met by a table of one row a
    host, which adaptive execution may broadcast or split.
    """
    spark = df.sparkSession
    kinds = (("plain", rules.plain), ("wildcard", rules.wildcard_parents), ("exception", rules.exceptions))
    listed = spark.createDataFrame([(k, r) for k, rs in kinds for r in sorted(rs)], "kind string, ending string")
    hosts = df.filter(F.col(host).isNotNull() & ~F.col(is_ip)).select(F.col(host).alias("_host")).distinct().withColumn("_labels", F.split("_host", r"\."))
    size = F.size("_labels")
    ends = hosts.select("_host", F.explode(F.sequence(F.lit(1), size)).alias("_k"), "_labels").withColumn("ending", F.array_join(F.slice("_labels", F.size("_labels") - F.col("_k") + 1, F.col("_k")), "."))
    met = ends.join(F.broadcast(listed), "ending")
    suffix = F.coalesce(F.max(F.when(F.col("kind") == "exception", F.col("_k") - 1)), F.max(F.when(F.col("kind") == "plain", F.col("_k")).when(F.col("kind") == "wildcard", F.least(F.col("_k") + 1, F.size("_labels")))))
    # A wildcard needs a label in its place: a host that is the parent itself has no match by it.
    met = met.filter((F.col("kind") != "wildcard") | (F.col("_k") < F.size("_labels")))
    found = met.groupBy("_host", "_labels").agg(suffix.alias("_s")).filter((F.col("_s") > 0) & (F.col("_s") < size))
    named = found.select("_host", F.array_join(F.slice("_labels", size - F.col("_s"), F.col("_s") + 1), ".").alias("_domain"))
    joined = df.join(named, F.col(host) == F.col("_host"), "left")
    return joined.select(*df.columns, F.coalesce("_domain", host).alias("registered_domain"))


def with_clean_urls(df: DataFrame, url: str = "url_raw", rules: SuffixRules = DEFAULT_RULES) -> DataFrame:
    """with_url_parts plus registered_domain."""
    parts = with_url_parts(df, url)
    if len(rules.plain) > _LISTED_RULES:
        return with_registered_domain(parts, rules)
    return parts.withColumn("registered_domain", registered_domain(F.col("host"), F.col("is_ip"), rules))


def site_url(domain: Column) -> Column:
    """The address whose registered domain stands for a bare domain."""
    return F.concat(F.lit("https://"), F.lower(F.trim(domain)), F.lit("/"))


def register_views(df: DataFrame, url: str = "url_raw", clean: str = "clean_urls", features: str = "url_features") -> None:
    """Let the session's SQL read a table's cleaned URLs (parts, registered_domain, reason) and their features, as two temporary views."""
    from urlloom.functions.features import with_features

    made = with_clean_urls(df, url)
    made.createOrReplaceTempView(clean)
    with_features(made, "expanded21").createOrReplaceTempView(features)


def require_valid(df: DataFrame) -> DataFrame:
    """Strict mode: an error for the first row that has a reason."""
    bad = df.filter(F.col("reason").isNotNull()).select("reason").first()
    if bad:
        raise ValueError(bad[0])
    return df


def is_public_ip(address: str) -> bool:
    """Globally reachable unicast, mapped addresses judged by what they map."""
    import ipaddress

    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    mapped = getattr(ip, "ipv4_mapped", None)
    if mapped is not None:
        return is_public_ip(str(mapped))
    return ip.is_global and not ip.is_multicast and not ip.is_unspecified


def public_ip_column(address: Column) -> Column:
    """``is_public_ip`` of a column, in Arrow batches; null is no public address."""
    @F.arrow_udf("boolean")
    def check(values: pa.Array) -> pa.Array:
        return pa.array([x is not None and is_public_ip(x) for x in values.to_pylist()], pa.bool_())

    return check(address)


def origin(scheme: Column, host: Column, port: Column) -> Column:
    """(scheme, host, effective port): equal for URLs of one origin."""
    return F.struct(scheme.alias("scheme"), host.alias("host"), F.coalesce(port, F.when(scheme == "https", 443).otherwise(80)).alias("port"))


def defanged(scheme: Column, domain: Column) -> Column:
    return F.concat(F.replace(scheme, F.lit("http"), F.lit("hxxp")), F.lit("://"), F.replace(domain, F.lit("."), F.lit("[.]")))


#: Query keys that may carry a credential.
TOKEN_KEYS = ["access_token", "auth", "authorization", "code", "jwt", "key", "password", "session", "sessionid", "sid", "sso", "ticket", "token"]


def sensitive_query(query: Column) -> Column:
    """True if a decoded query key is in TOKEN_KEYS or contains token, session or auth."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    keys = F.transform(pairs, lambda x: F.lower(F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1))))
    return F.exists(keys, lambda k: k.isin(TOKEN_KEYS) | k.rlike("token|session|auth"))


def page_policy(df: DataFrame, group: str = "domain_group") -> DataFrame:
    """Adds ``decision`` to rows with URL parts: null if the page may be used, else why not."""
    return df.withColumn(
        "decision",
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("invalid_url:"), F.col("reason")))
        .when(F.col("userinfo").rlike("[^:]"), "credentials_in_url")
        .when(F.col("registered_domain") != F.col(group), "cross_domain")
        .when(sensitive_query(F.col("query")), "sensitive_query_key"),
    )


def capture_policy(df: DataFrame, group: str = "domain_group") -> DataFrame:
    """page_policy, and no user information at all and only the default ports."""
    strict = page_policy(df, group)
    return strict.withColumn(
        "decision",
        F.when(F.col("reason").isNull() & F.col("userinfo").isNotNull(), "credentials_in_url")
        .when(F.col("decision").isNotNull(), F.col("decision"))
        .when(~F.coalesce("port", F.lit(80)).isin(80, 443), "disallowed_port"),
    )


def destination_policy(df: DataFrame) -> DataFrame:
    """Adds ``refusal`` for proxied destinations, judged by URL parts only."""
    local = F.col("host").isin("localhost", "metadata", "metadata.google.internal") | F.col("host").endswith(".localhost")
    return df.withColumn(
        "refusal",
        F.when(F.col("reason").isNotNull() | F.col("userinfo").isNotNull(), "invalid_destination")
        .when(~F.coalesce("port", F.lit(80)).isin(80, 443), "disallowed_port")
        .when(local, "non_public_destination"),
    )
