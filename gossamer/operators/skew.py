"""Per-key results when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions.url import BLANKS, crawlable, host_of
from gossamer.session import cut_lineage

KINDS = ("count", "sum", "min", "max")


def heavy_hashes(df: DataFrame, keys: Sequence[str], support: float) -> list[int]:
    """64-bit hashes of the keys on more than ``support`` of the rows, and perhaps of others: at most 1 / support, by one pass of counters
    that keep only so many keys. None is missed."""
    found = df.select(F.xxhash64(*[df[k] for k in keys]).alias("h")).stat.freqItems(["h"], support).first()[0]
    return [h for h in found or [] if h is not None]


def salted_aggregate(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, Column]], salts: int = 64, like: DataFrame | None = None) -> DataFrame:
    """One row per key with the named measures, by partial results per (key, salt) and a merge of at most ``salts`` partials a key.

    ``measures`` maps an output name to (kind, column), kind one of count, sum, min, max. Keys that may hold over one in 2 * ``salts`` of the rows
    are heavy: each of their rows has a random salt, all other keys have salt 0. So no task holds more than its share of one key: the first
    shuffle spreads a heavy key over ``salts`` groups, the second moves one row per group. Heavy keys are looked for in ``like``, rows
    of the same keys that are cheaper to read, if given. Rows are drawn by a seed, and where the order of rows isn't sure Spark repeats the
    whole stage of a lost task, so no row counts twice.

    Null keys form a group of their own; a count skips null values, as SQL's does; an empty table gives no row; other columns
    of ``df``, also such named like an output, play no part. Two equal keys are never split over two output rows.
    """
    for name, (kind, _) in measures.items():
        if kind not in KINDS:
            raise ValueError(f"{name}: unknown measure {kind!r}")
        if name in keys:
            raise ValueError(f"{name} is a key and a measure")
    heavy = heavy_hashes(df if like is None else like, keys, 1 / (2 * salts))
    salt = F.when(F.xxhash64(*[df[k] for k in keys]).isin(heavy), F.floor(F.rand(17) * salts)) if heavy else F.lit(None)
    picked = df.select(
        *[df[k].alias(f"k{i}") for i, k in enumerate(keys)],
        *[c.alias(f"m{i}") for i, (_, c) in enumerate(measures.values())],
        F.coalesce(salt, F.lit(0)).cast("int").alias("salt"),
    )
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    key_cols = [f"k{i}" for i in range(len(keys))]
    kinds = [kind for kind, _ in measures.values()]
    partial = picked.groupBy(*key_cols, "salt").agg(*[first[kind](f"m{i}").alias(f"m{i}") for i, kind in enumerate(kinds)])
    merged = partial.groupBy(*key_cols).agg(*[merge[kind](f"m{i}").alias(f"m{i}") for i, kind in enumerate(kinds)])
    return merged.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"m{i}").alias(name) for i, name in enumerate(measures)])


def heavy_keys(df: DataFrame, key: str, share: float, salts: int = 64, like: DataFrame | None = None) -> DataFrame:
    """(key, n_rows, n_total) of the keys on at least ``share`` of all rows. Rows with a null key count in the total, but are no key."""
    # A row a key, stored: it is read for the total and for the keys.
    counts = cut_lineage(salted_aggregate(df, [key], {"n_rows": ("count", F.lit(1))}, salts, like))
    total = counts.agg(F.sum("n_rows").alias("n_total")).scalar()
    return counts.where(F.col(key).isNotNull()).withColumn("n_total", total).where(F.col("n_rows") >= F.lit(share) * F.col("n_total"))


def message_hosts(messages: DataFrame) -> DataFrame:
    """(msg_id, host) of every delivery with an id and a crawlable url, host in lower case. Only the host is cut out of the url."""
    rows = messages.where(F.col("msg_id").isNotNull() & crawlable(F.col("url")))
    return rows.select("msg_id", host_of(F.btrim("url", F.lit(BLANKS))).alias("host"))


def crawlable_hosts(messages: DataFrame) -> DataFrame:
    """``message_hosts``, each message once: one delivered twice has equal rows."""
    return message_hosts(messages).distinct()


def host_counts(messages: DataFrame, salts: int = 64) -> DataFrame:
    """(host, n_rows): distinct messages with a crawlable url per host in lower case, salted."""
    return salted_aggregate(crawlable_hosts(messages).select("host"), ["host"], {"n_rows": ("count", F.lit(1))}, salts, message_hosts(messages))


def heavy_hosts(document: DataFrame, messages: DataFrame, share: float = 0.04, salts: int = 64) -> DataFrame:
    """(table_name, registered_domain): hosts on at least ``share`` of the rows of document, and of the crawlable messages."""
    documents = heavy_keys(document.select("registered_domain"), "registered_domain", share, salts)
    frontier = heavy_keys(crawlable_hosts(messages).select("host"), "host", share, salts, message_hosts(messages))
    named = frontier.select(F.lit("frontier_message").alias("table_name"), F.col("host").alias("registered_domain"))
    return documents.select(F.lit("document").alias("table_name"), "registered_domain").unionAll(named)


def domain_profile(document: DataFrame, salts: int = 64) -> DataFrame:
    """Per registered_domain: rows, rows with a body, bytes, first sight and last fetch in microseconds; null domains are one group."""
    return salted_aggregate(
        document,
        ["registered_domain"],
        {
            "n_rows": ("count", F.lit(1)),
            "n_bodies": ("count", F.col("content_hash")),
            "total_bytes": ("sum", F.coalesce(F.col("content_length"), F.lit(0)).cast("long")),
            "first_seen_us": ("min", F.unix_micros("first_seen")),
            "last_crawled_us": ("max", F.unix_micros("last_crawled")),
        },
        salts,
    )
