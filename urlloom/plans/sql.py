"""Building blocks of the SQL that queries are compared with (DuckDB dialect; FEED also runs in Spark)."""

from __future__ import annotations

from urlloom.functions import urls
from urlloom.functions.features import KEYWORDS
from urlloom.functions.urls import IPV4

_HOST = "split_part(split_part(url, '://', 2), '/', 1)"
_SCHEME = "split_part(url, '://', 1)"
_BAD = ["ftp://x.example.com/", "http://in ner.example.com/", "http://a..b/", "http://under_score.example.com/", "http:///x", "http://h.example.com:99999/", "no-scheme", "http://dot.example.com./", "   "]

#: Parsed feed rows made from pages: (source, label, row_number, url_raw, error).
FEED = f"""
SELECT 'phishtank' AS source, 1 AS label, page_id AS row_number, url AS url_raw, CAST(NULL AS {{text}}) AS error FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT 'phishtank', 1, page_id + 1000000, url, NULL FROM pages WHERE page_id % 9 = 0
UNION ALL SELECT 'openphish', 1, page_id, concat(upper({_SCHEME}), '://', upper({_HOST}), CASE WHEN {_SCHEME} = 'https' THEN ':443' ELSE ':80' END, '/',
  substr(url, length({_SCHEME}) + length({_HOST}) + 5), '#x'), NULL FROM pages WHERE page_id % 6 = 0
UNION ALL SELECT 'openphish', 1, page_id + 3000000, concat({_SCHEME}, '://user@', split_part(url, '://', 2)), NULL FROM pages WHERE page_id % 10 = 1
UNION ALL SELECT 'tranco', 0, page_id, url, NULL FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT 'tranco', 0, page_id + 2000000, url, NULL FROM pages WHERE page_id % 21 = 0
UNION ALL SELECT 'openphish', 1, CAST(n AS bigint), u, e FROM (VALUES {", ".join(f"({i}, '{u}', NULL)" for i, u in enumerate(_BAD, 9000000))}, (9000100, NULL, 'missing URL')) AS bad(n, u, e)
"""

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def clean(source: str) -> str:
    """A subquery that adds the parts of url_raw (ASCII, no brackets) to ``source``."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return f"""(
  SELECT * EXCLUDE (t, x_netloc, x_path, info, ptext, pnum, x_scheme, x_host, x_query, x_ip),
    CASE WHEN reason IS NULL THEN x_scheme END AS scheme, CASE WHEN reason IS NULL THEN x_host END AS host, CASE WHEN reason IS NULL THEN x_query END AS query,
    CASE WHEN reason IS NULL THEN x_ip END AS is_ip,
    CASE WHEN reason IS NULL AND pnum IS NOT NULL AND NOT (x_scheme = 'http' AND pnum = 80 OR x_scheme = 'https' AND pnum = 443) THEN pnum::INTEGER END AS port,
    CASE WHEN reason IS NULL THEN CASE WHEN x_path = '' THEN '/' ELSE x_path END END AS path,
    CASE WHEN reason IS NULL AND contains(x_netloc, '@') THEN x_netloc[1 : len(x_netloc) - len(info) - 1] END AS userinfo,
    CASE WHEN reason IS NULL THEN x_scheme || '://' || CASE WHEN contains(x_netloc, '@') THEN regexp_extract(x_netloc, '^(.*@)', 1) ELSE '' END || x_host
      || coalesce(':' || port, '') || path || CASE WHEN x_query <> '' THEN '?' || x_query ELSE '' END END AS url_clean,
    CASE WHEN reason IS NULL THEN CASE WHEN NOT x_ip AND len(string_split(x_host, '.')) > 1 AND string_split(x_host, '.')[-1] IN ('com', 'net', 'org')
      THEN string_split(x_host, '.')[-2] || '.' || string_split(x_host, '.')[-1] ELSE x_host END END AS registered_domain
  FROM (
    SELECT *, trim(url_raw) AS t, lower(regexp_extract(t, '{_SPLIT}', 1)) AS x_scheme, regexp_extract(t, '{_SPLIT}', 2) AS x_netloc, regexp_extract(t, '{_SPLIT}', 3) AS x_path,
      regexp_extract(t, '{_SPLIT}', 4) AS x_query, regexp_extract(x_netloc, '([^@]*)$', 1) AS info, lower(regexp_extract(info, '^([^:]*)', 1)) AS x_host,
      regexp_extract(info, '^[^:]*:(.*)$', 1) AS ptext, TRY_CAST(CASE WHEN regexp_full_match(ptext, '[0-9]+') THEN ptext END AS BIGINT) AS pnum,
      regexp_full_match(x_host, '{IPV4}') AS x_ip,
      CASE WHEN url_raw IS NULL THEN '{urls.NOT_STRING}'
        WHEN t = '' OR regexp_matches(t, '[\\s\\x00-\\x1f\\x7f]') THEN '{urls.BLANK}'
        WHEN ptext <> '' AND (pnum IS NULL OR pnum > 65535) THEN '{urls.MALFORMED}'
        WHEN x_scheme NOT IN ('http', 'https') THEN '{urls.SCHEME}'
        WHEN x_host = '' THEN '{urls.NO_HOST}'
        WHEN regexp_matches(x_host, '^\\.|\\.\\.|[^.]{{64}}') THEN '{urls.NOT_IDNA}'
        WHEN NOT x_ip AND (len(x_host) > 253 OR NOT regexp_full_match(x_host, '{label}(?:\\.{label})*')) THEN '{urls.BAD_LABEL}' END AS reason
    FROM {source}))"""


def occurrences(text: str, part: str) -> str:
    return f"((len({text}) - len(replace({text}, '{part}', ''))) // {len(part)})::INTEGER"


_KEYWORDS = " + ".join(occurrences("lower(url_clean)", w) for w in KEYWORDS)
FEATURES = f"""
  len(url_clean)::INTEGER AS url_length, len(host)::INTEGER AS hostname_length, len(path)::INTEGER AS path_length, len(query)::INTEGER AS query_length, {occurrences("url_clean", ".")} AS dot_count,
  CASE WHEN is_ip THEN 0 ELSE greatest(len(string_split(host, '.')) - len(string_split(registered_domain, '.')), 0) END::INTEGER AS subdomain_count,
  {occurrences("url_clean", "/")} AS slash_count, len(regexp_extract_all(url_clean, '\\p{{Nd}}'))::INTEGER AS digit_count, len(regexp_extract_all(url_clean, '\\p{{Nd}}')) / len(url_clean) AS digit_ratio,
  {occurrences("url_clean", "-")} AS hyphen_count, {occurrences("url_clean", "@")} AS at_count, {occurrences("url_clean", "?")} AS question_count, {occurrences("url_clean", "=")} AS equals_count,
  {occurrences("url_clean", "&")} AS ampersand_count, (scheme = 'https')::INTEGER AS uses_https, is_ip::INTEGER AS is_ip_hostname, ({_KEYWORDS})::INTEGER AS suspicious_keyword_count,
  -list_sum(list_transform(list_distinct(string_split(url_clean, '')), lambda c: (len(list_filter(string_split(url_clean, ''), lambda x: x = c)) / len(url_clean)) * log2(len(list_filter(string_split(url_clean, ''), lambda x: x = c)) / len(url_clean)))) AS url_entropy,
  len(regexp_extract_all(host, '\\p{{Nd}}')) / len(host) AS hostname_digit_ratio, len(regexp_extract_all(url_clean, '%[0-9A-Fa-f]{{2}}'))::INTEGER AS percent_encoded_count,
  (port IS NOT NULL)::INTEGER AS has_nondefault_port"""
FEED_DUCK = f"({FEED.format(text='VARCHAR')})"
CLEAN_FEED = clean(FEED_DUCK)
#: Pages with a label, cleaned; groups are hosts.
LABELLED = clean("(SELECT p.page_id, p.url AS url_raw, l.quality AS label, l.toxic, 'src' || (p.page_id % 3) AS source FROM pages p JOIN labels l ON p.page_id = l.doc_id)")
PAGES = clean("(SELECT page_id, url AS url_raw FROM pages)")
DISPOSITIONS = f"""(
  SELECT source, label, row_number, url_raw, CASE WHEN invalid IS NULL THEN url_clean END AS url_clean, CASE WHEN invalid IS NULL THEN registered_domain END AS registered_domain,
    CASE WHEN invalid IS NOT NULL THEN 'invalid: ' || invalid WHEN mixed THEN 'conflicting_label' WHEN nth = 1 THEN NULL WHEN raw_at > 1 THEN 'exact_duplicate' ELSE 'normalized_duplicate' END AS reason
  FROM (
    SELECT *, min(label) OVER (PARTITION BY key) <> max(label) OVER (PARTITION BY key) AS mixed,
      row_number() OVER (PARTITION BY key ORDER BY priority, source, url_raw, row_number) AS nth,
      row_number() OVER (PARTITION BY key, url_raw ORDER BY priority, source, url_raw, row_number) AS raw_at
    FROM (
      SELECT *, CASE WHEN error IS NOT NULL OR url_raw IS NULL THEN coalesce(error, 'missing URL') ELSE reason END AS invalid,
        CASE source WHEN 'phishtank' THEN 0 WHEN 'openphish' THEN 1 WHEN 'tranco' THEN 2 ELSE 3 END AS priority,
        coalesce(url_clean, 'bad' || row_number) AS key
      FROM {CLEAN_FEED})))"""
