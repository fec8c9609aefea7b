"""The 21 lexical URL features, their named sets, and summaries' kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlloom.functions.urls import subdomain_count

#: Words, feature names and sets that results depend on.
KEYWORDS = ("account", "bank", "confirm", "login", "password", "secure", "signin", "update", "verify")
BASELINE = [
    "url_length", "hostname_length", "path_length", "query_length", "dot_count", "subdomain_count",
    "slash_count", "digit_count", "digit_ratio", "hyphen_count", "at_count", "question_count",
    "equals_count", "ampersand_count", "uses_https", "is_ip_hostname", "suspicious_keyword_count", "url_entropy",
]
EXTRA = ["hostname_digit_ratio", "percent_encoded_count", "has_nondefault_port"]
BINARY = ("uses_https", "is_ip_hostname")
FLOATS = ("digit_ratio", "url_entropy", "hostname_digit_ratio")
METADATA = ("url_raw", "url_clean", "label", "source", "registered_domain", "sample_id", "split")
FEATURE_SETS = {
    "baseline": BASELINE,
    "no_https": [x for x in BASELINE if x != "uses_https"],
    "compact16": [x for x in BASELINE if x not in ("uses_https", "suspicious_keyword_count")],
    "expanded21": [*BASELINE, *EXTRA],
    "hostname_only": ["hostname_length", "subdomain_count", "is_ip_hostname", "hostname_digit_ratio"],
    "https_only": ["uses_https"],
    "structure_only": ["uses_https", "path_length", "query_length"],
}


def resolve(names: str | list[str]) -> list[str]:
    """A named set or an own ordered list (comma-separated or not), checked."""
    if isinstance(names, str):
        names = FEATURE_SETS.get(names, [x.strip() for x in names.split(",") if x.strip()])
    if not names:
        raise ValueError("feature set must not be empty")
    problems = {
        "duplicate feature names": sorted({x for x in names if names.count(x) > 1}),
        "metadata columns cannot be model features": sorted(set(names) & set(METADATA)),
        "unknown feature names": sorted(set(names) - {*BASELINE, *EXTRA}),
    }
    for text, found in problems.items():
        if found:
            raise ValueError(f"{text}: {', '.join(found)}")
    return list(names)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("int")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over characters."""
    chars = F.split(text, "")
    size = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / size)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def with_features(df: DataFrame, names: str | list[str] = "baseline") -> DataFrame:
    """Adds features to rows with URL parts and registered_domain; null where the URL is rejected."""
    u, h, q = F.col("url_clean"), F.col("host"), F.col("query")
    digits = F.regexp_count(u, F.lit(r"\p{Nd}"))
    low = F.lower(u)
    words = sum((occurrences(low, w) for w in KEYWORDS[1:]), occurrences(low, KEYWORDS[0]))
    made = {
        "url_length": F.length(u),
        "hostname_length": F.length(h),
        "path_length": F.length("path"),
        "query_length": F.length(q),
        "dot_count": occurrences(u, "."),
        "subdomain_count": subdomain_count(h, F.col("is_ip"), F.col("registered_domain")),
        "slash_count": occurrences(u, "/"),
        "digit_count": digits,
        "digit_ratio": digits / F.length(u),
        "hyphen_count": occurrences(u, "-"),
        "at_count": occurrences(u, "@"),
        "question_count": occurrences(u, "?"),
        "equals_count": occurrences(u, "="),
        "ampersand_count": occurrences(u, "&"),
        "uses_https": (F.col("scheme") == "https").cast("int"),
        "is_ip_hostname": F.col("is_ip").cast("int"),
        "suspicious_keyword_count": words,
        "url_entropy": entropy(u),
        "hostname_digit_ratio": F.regexp_count(h, F.lit(r"\p{Nd}")) / F.length(h),
        "percent_encoded_count": F.regexp_count(u, F.lit("%[0-9A-Fa-f]{2}")),
        "has_nondefault_port": F.col("port").isNotNull().cast("int"),
    }
    return df.select("*", *[F.when(u.isNotNull(), made[x]).alias(x) for x in resolve(names)])


def aligned(df: DataFrame, names: str | list[str], values: str = "features", allow_missing: bool = False) -> DataFrame:
    """Rows of a map column (feature -> number) with one double column for each name, in order, and ``problem``.

    problem names the first unregistered key, then the first missing or non-finite value; with ``allow_missing`` a missing or
    NaN value is null instead. Registered keys outside ``names`` are ignored.
    """
    wanted, known = resolve(names), F.array(*map(F.lit, [*BASELINE, *EXTRA]))
    strange = F.array_min(F.array_except(F.map_keys(values), known))
    problem, columns = F.when(strange.isNotNull(), F.concat(F.lit("unknown: "), strange)), []
    for n in wanted:
        x = F.try_element_at(values, F.lit(n)).cast("double")
        gone = x.isNull() | F.isnan(x)
        problem = F.coalesce(problem, F.when(F.abs(x) == float("inf"), F.lit(f"not finite: {n}")), F.lit(None) if allow_missing else F.when(gone, F.lit(f"missing: {n}")))
        columns.append(F.when(~gone, x).alias(n))
    return df.select(*df.columns, *columns, problem.alias("problem"))
