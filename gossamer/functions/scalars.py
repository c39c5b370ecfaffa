"""Small native functions over statuses, intervals, headers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_CAP_SECONDS = 30
_FNV_OFFSET, _FNV_PRIME, _MASK32 = 2166136261, 16777619, 4294967295


def status_class(status: Column) -> Column:
    """"2xx" and so on; 0 and below is "error"; null stays null."""
    return F.when(status <= 0, "error").when(status.isNotNull(), F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))


def status_band(status: Column) -> Column:
    """Band of a status in a display: unknown, ok, redirect, client or server."""
    return F.when(status.isNull(), "unknown").when(status < 300, "ok").when(status < 400, "redirect").when(status < 500, "client").otherwise("server")


def hash01(text: Column) -> Column:
    """FNV-1a of the text's characters in 32 bits, as a share of 2**32 - 1; null stays null."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # The product stays under 2**56, so a long holds it.
    folded = F.aggregate(codes, F.lit(_FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(_FNV_PRIME).cast("long")).bitwiseAND(F.lit(_MASK32).cast("long")))
    return folded / F.lit(float(_MASK32))


def node_size(degree: Column) -> Column:
    return F.lit(2.4) + F.least(F.lit(9.0), F.lit(1.7) * F.sqrt(degree.cast("double")))


def short_path(path: Column, longest: int = 18) -> Column:
    """A path over ``longest`` characters is cut to one less and an ellipsis."""
    return F.when(F.length(path) > longest, F.concat(F.substring(path, 1, longest - 1), F.lit("…"))).otherwise(path)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC to the second; the session's zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def page_label(offset: Column, shown: Column, total: Column) -> Column:
    """"1–25 of 790"; "0 of 0" for nothing."""
    return F.when(total == 0, "0 of 0").otherwise(F.concat((offset + 1).cast("string"), F.lit("–"), (offset + shown).cast("string"), F.lit(" of "), total.cast("string")))


def next_interval(current: Column, changed: Column, least: float, most: float, factor: float) -> Column:
    """Re-visit interval: the least if the page changed or had none, else ``factor`` times the current up to the most."""
    return F.when(changed | current.isNull(), F.lit(least)).otherwise(F.least(current * F.lit(factor), F.lit(most)))


def effective_delay_ms(default_ms: Column, robots_seconds: Column) -> Column:
    """The larger of the default and what robots.txt asks for, in whole milliseconds."""
    return F.greatest(default_ms.cast("long"), F.coalesce((robots_seconds * 1000).cast("long"), F.lit(0)))


def refill_per_second(delay_ms: Column) -> Column:
    return F.when(delay_ms > 0, F.lit(1000.0) / delay_ms)


def retry_delay(attempts: Column) -> Column:
    """min(2**attempts, 30) seconds."""
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(float(RETRY_CAP_SECONDS)))


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """Map of If-None-Match and If-Modified-Since for the validators there are; null if there is none."""
    headers = F.map_filter(F.create_map(F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), last_modified), lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(headers) > 0, headers)


def header(headers: Column, name: str) -> Column:
    """Value of a header whatever its case: the first entry that matches."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), 0)["value"]
