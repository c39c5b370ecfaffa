"""Queries of the salted aggregation."""

from __future__ import annotations

from gossamer.functions.url import duckdb_normalized
from gossamer.operators import skew
from gossamer.plans.registry import query, table

_MESSAGES = f"SELECT DISTINCT msg_id, u, regexp_replace(regexp_replace(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host FROM (SELECT msg_id, {duckdb_normalized('url')} AS u FROM frontier_message) WHERE u IS NOT NULL AND msg_id IS NOT NULL"


@query(
    "p6_found",
    f"""WITH m AS ({_MESSAGES}),
    d AS (SELECT registered_domain, count(*) AS n FROM document GROUP BY 1), h AS (SELECT host AS registered_domain, count(*) AS n FROM m GROUP BY 1)
    SELECT 'document' AS table_name, registered_domain FROM d WHERE registered_domain IS NOT NULL AND n >= 0.04 * (SELECT sum(n) FROM d)
    UNION ALL SELECT 'frontier_message', registered_domain FROM h WHERE n >= 0.04 * (SELECT sum(n) FROM h)""",
)
def p6_found(spark, d):
    return skew.heavy_hosts(table(spark, d, "document"), table(spark, d, "frontier_message"))


@query("p6_host_messages", f"WITH m AS ({_MESSAGES}) SELECT host, count(*) AS n_rows FROM m GROUP BY 1")
def p6_host_messages(spark, d):
    return skew.host_counts(table(spark, d, "frontier_message"))


@query(
    "p6_domain_profile",
    """SELECT registered_domain, count(*) AS n_rows, count(content_hash) AS n_bodies, CAST(sum(coalesce(content_length, 0)) AS BIGINT) AS total_bytes,
    epoch_us(min(first_seen)) AS first_seen_us, epoch_us(max(last_crawled)) AS last_crawled_us FROM document GROUP BY 1""",
)
def p6_domain_profile(spark, d):
    return skew.domain_profile(table(spark, d, "document"))
