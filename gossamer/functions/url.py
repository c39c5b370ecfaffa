"""URL functions: native columns for the hot path, a stdlib version for hrefs that need a base."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track visits.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src", "_ga",
)
# Hrefs that lead to no page.
SKIPPED_PREFIXES = ("javascript:", "mailto:", "tel:", "data:", "#")
# What counts as a blank around a URL, by Unicode.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Public suffixes by rule, as no list ships with the environment: a country code of two letters, one of these labels before a country code,
# or one of these endings. Names under other endings (reserved and internal ones too) are their own.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "govt", "id", "ltd", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch")
ENDINGS = ("aero", "app", "biz", "cat", "cloud", "com", "coop", "dev", "edu", "gov", "info", "int", "jobs", "mil", "mobi", "museum", "name", "net", "online", "org", "page", "pro", "shop", "site", "tel", "travel", "xyz")


def upper_escapes(text: Column) -> Column:
    """Percent escapes in upper case; text without a percent sign passes untouched."""
    parts = F.split(text, "%")
    fixed = F.transform(
        parts,
        lambda x, i: F.when((i > 0) & x.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, F.lit(3), F.length(x)))).otherwise(x),
    )
    return F.when(text.contains("%"), F.concat_ws("%", fixed)).otherwise(text)


def crawlable(url: Column) -> Column:
    """Whether ``normalize_url`` gives a form: http or https with a host. Null gives null, which a filter drops.

    One match on the raw text. A filter on the normalized column itself would be pushed below its projection and normalize twice.
    """
    return url.rlike(r"(?i)^[\s\p{Z}\x1c-\x1f\x85]*https?://(?:[^/?#]*@)?[^/?#:@\s\p{Z}][^/?#@]*(?:[/?#]|$)")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it: Catalyst would inline it each time."""
    return F.get(F.transform(F.array(value), body), 0)


#: What a canonical URL holds as it is; anything else is percent-encoded.
UNSAFE = r"""[^!-~]|["<>\\^`{|}]"""


def encode_unsafe(text: Column) -> Column:
    """Characters that a URL may not hold as percent escapes of their UTF-8 bytes; other text passes untouched."""
    coded = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(UNSAFE), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(text.rlike(UNSAFE), F.array_join(coded, "")).otherwise(text)


def normalize_url(url: Column, first_of_equal_names: bool = False, encoded: bool = False) -> Column:
    """The form under which spellings of one URL are equal, as a native column; null if the URL can't be crawled.

    Blanks around it go; only http and https with a host stay; scheme and host are lower case; fragment and tracking
    parameters go; the other parameters are sorted by name, then value; percent escapes are upper case; an empty path is "/".
    ``first_of_equal_names`` keeps only the first of several parameters with one name; ``encoded`` percent-encodes what a URL may not
    hold. Null and empty give null.
    """

    def rebuilt(s: Column) -> Column:
        # Cut by separators rather than by patterns: each part is a native substring.
        before = F.substring_index(s, "://", 1)
        rest = F.substring_index(F.substring(s, F.length(before) + 4, F.length(s)), "#", 1)
        return _let(F.struct(F.lower(before).alias("scheme"), rest.alias("rest"), F.substring_index(rest, "?", 1).alias("address")), addressed)

    def addressed(x: Column) -> Column:
        netloc = F.substring_index(x["address"], "/", 1)
        bare = F.substring_index(netloc, "@", -1)
        host = F.concat(F.substring(netloc, F.lit(1), F.length(netloc) - F.length(bare)), F.lower(bare))
        path = F.substring(x["address"], F.length(netloc) + 1, F.length(x["address"]))
        query = F.substring(x["rest"], F.length(x["address"]) + 2, F.length(x["rest"]))
        return F.when(
            x["scheme"].isin("http", "https") & (bare != "") & ~bare.startswith(":"),
            F.concat(x["scheme"], F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(x["rest"].contains("?"), cleaned(query)).otherwise("")),
        )

    def cleaned(query: Column) -> Column:
        named = F.transform(F.split(query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("pair")))
        kept = F.filter(named, lambda p: (p["pair"] != "=") & ~p["name"].isin(*TRACKING))
        if first_of_equal_names:
            kept = _let(kept, lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, lambda q: q["name"]), p["name"]) == i + 1))
        joined = F.concat_ws("&", F.transform(F.sort_array(kept), lambda p: p["pair"]))
        return _let(joined, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))

    trimmed = F.btrim(url, F.lit(BLANKS))
    if encoded:
        return _let(trimmed, lambda t: _let(encode_unsafe(t), lambda e: _let(upper_escapes(e), rebuilt)))
    return _let(upper_escapes(trimmed), rebuilt)


def host_of(url: Column) -> Column:
    """Host in lower case without user or port; null if there is none."""
    netloc = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(netloc), "^.*@", ""), r":\d*$", "")
    return F.when(host != "", host)


def registered_domain_of_host(host: Column) -> Column:
    """Registrable name of a host: the label before a public suffix, with it; an address or an unknown ending keeps the host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    country = F.get(labels, n - 1).rlike("^[a-z]{2}$")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    return (
        F.when(host.rlike(r"^[0-9.]+$|:"), host)
        .when(country & (n >= 2) & F.get(labels, n - 2).isin(*SECOND_LABELS), F.when(n >= 3, tail(3)).otherwise(host))
        .when((n >= 2) & (country | F.get(labels, n - 1).isin(*ENDINGS)), tail(2))
        .otherwise(host)
    )


def registered_domain(url: Column) -> Column:
    """Registrable name of a URL's host; "" if it has no host."""
    return F.coalesce(registered_domain_of_host(host_of(url)), F.lit(""))


def origin_of(url: Column) -> Column:
    """scheme://host[:port] as written; "" if there is none."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


_ESCAPE = re.compile("%[0-9a-fA-F]{2}")
_SAFE = "".join(c for c in map(chr, range(33, 127)) if not re.match(UNSAFE, c))


def normalize_href(href: str | None, base: str | None = None) -> str | None:
    """``normalize_url`` of an href against its page's URL, in plain Python; malformed hrefs give null."""
    if not href:
        return None
    href = href.strip()
    if not href or href.lower().startswith(SKIPPED_PREFIXES):
        return None
    try:
        parts = urlsplit(urljoin(base, href) if base else href)
        host = parts.hostname
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host:
        return None
    kept: dict[str, str] = {}
    for pair in parts.query.split("&"):
        name = pair.partition("=")[0]
        if pair and name not in TRACKING and name not in kept:
            kept[name] = pair if "=" in pair else pair + "="
    user, at, bare = parts.netloc.rpartition("@")
    query = "&".join(kept[name] for name in sorted(kept))
    out = f"{parts.scheme}://{user}{at}{bare.lower()}{parts.path or '/'}{'?' + query if query else ''}"
    return _ESCAPE.sub(lambda m: m[0].upper(), quote(out, safe=_SAFE))


@F.pandas_udf(T.StringType())
def normalize_hrefs(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
    """Arrow function (href, base) → normalized url or null."""
    return pd.Series([normalize_href(h, b) for h, b in zip(hrefs, bases)], dtype=object)


def duckdb_normalized(url: str, first_of_equal_names: bool = False, encoded: bool = False) -> str:
    """The SQL twin of ``normalize_url``: an expression over the column ``url`` for an engine with list lambdas."""
    names = ", ".join(f"'{t}'" for t in TRACKING)
    s = f"trim({url}, '{BLANKS}')"
    if encoded:
        s = f"array_to_string(list_transform(regexp_extract_all({s}, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '{UNSAFE}') THEN regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), '')"
    s = (
        f"array_to_string(list_transform(string_split({s}, '%'), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '^[0-9a-fA-F]{{2}}') "
        f"THEN upper(x[1:2]) || x[3:] ELSE x END), '%')"
    )
    named = f"list_transform(string_split(regexp_extract({s}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: {{'name': split_part(p, '=', 1), 'pair': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}})"
    kept = f"list_filter({named}, lambda p: p.pair <> '=' AND p.name NOT IN ({names}))"
    if first_of_equal_names:
        kept = f"list_filter({kept}, lambda p, i: list_position(list_transform({kept}, lambda q: q.name), p.name) = i)"
    query = f"array_to_string(list_transform(list_sort({kept}), lambda p: p.pair), '&')"
    netloc = f"regexp_extract({s}, '^[A-Za-z]+://([^/?#]*)', 1)"
    path = f"regexp_extract({s}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    scheme = f"lower(regexp_extract({s}, '^([A-Za-z]+)://', 1))"
    return (
        f"CASE WHEN {scheme} IN ('http', 'https') AND regexp_matches(regexp_replace({netloc}, '^.*@', ''), '^([^:]|\\[)') "
        f"THEN {scheme} || '://' || regexp_extract({netloc}, '^(.*@)', 1) || lower(regexp_replace({netloc}, '^.*@', '')) "
        f"|| CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )
