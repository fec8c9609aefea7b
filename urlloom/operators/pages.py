"""Links, sitemaps and robots rules from recorded texts. Nothing is fetched."""

from __future__ import annotations

from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def hrefs(html: Column) -> Column:
    """href values of anchors, in order; entities are decoded where URLs have them (&amp;)."""
    each = [F.regexp_extract_all(html, F.lit(_HREF), F.lit(i)) for i in (1, 2, 3)]
    merged = F.zip_with(F.zip_with(each[0], each[1], lambda a, b: F.concat(a, b)), each[2], lambda a, b: F.concat(a, b))
    return F.transform(merged, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def links(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, href) from 0."""
    return df.select(key, F.posexplode(hrefs(F.coalesce(F.col(html), F.lit("")))).alias("position", "href"))


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute URL, as the standard library joins them."""

    @F.pandas_udf("string")
    def join(bases: pd.Series, hs: pd.Series) -> pd.Series:
        def one(b, h):
            try:
                return urljoin(b or "", h or "")
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(bases, hs, strict=True)])

    return join(base, href)


def sitemap_locations(xml: Column) -> Column:
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def robots_allows(text: Column, agent: str, url: Column) -> Column:
    """Whether the rules let the agent fetch the URL; a null text forbids all."""

    @F.pandas_udf("boolean")
    def allows(texts: pd.Series, urls: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(t, u):
            if t is None or u is None:
                return False
            if t not in parsers:
                parsers.clear()
                parsers[t] = RobotFileParser()
                parsers[t].parse(t.splitlines())
            return parsers[t].can_fetch(agent, u)

        return pd.Series([one(t, u) for t, u in zip(texts, urls, strict=True)])

    return allows(text, url)


def robots_sitemaps(text: Column, most: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), 1, most)
