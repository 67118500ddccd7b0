"""URL expressions built from one pattern, so that they need no URL library."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#\s]+)([^?#]*)(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def is_absolute_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))


def normalize_url(url: Column) -> Column:
    """Scheme, lower-case host without its default port, path without trailing slash, query; no fragment."""
    scheme = F.lower(_part(url, 1))
    host = F.lower(_part(url, 2))
    host = (
        F.when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .otherwise(host)
    )
    path = F.when(_part(url, 3).isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(_part(url, 3), "/$", ""))
    query = F.when(_part(url, 4) == "?", F.lit("")).otherwise(_part(url, 4))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path, query)).otherwise(url)


def brand_host(website: Column) -> Column:
    """Host of the brand's site without "www."; NULL when there is no usable URL."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(website, 2)), r":\d+$", ""), r"^www\.", "")
    return F.when(host != "", host)
