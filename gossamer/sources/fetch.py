"""Fetching pages: a batch operator over a pluggable transport, retried with back-off and capped in size."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "url string, final_url string, status int, headers map<string,string>, body binary, content_type string, elapsed double, error string"


@dataclass(frozen=True)
class FetchOptions:
    """What a session of fetches keeps to."""

    retries: int = 2
    max_bytes: int = 5_000_000
    backoff_seconds: float = 0.25
    backoff_cap: float = 5.0
    total_timeout: float = 30.0
    connect_timeout: float = 10.0
    connections: int = 100
    user_agent: str = "gossamer/0.1"


#: (url, request headers, options) -> (final url, status, headers, body); raises on failure.
Transport = Callable[[str, dict[str, str], FetchOptions], tuple[str, int, dict[str, str], bytes]]


def http_transport(url: str, headers: dict[str, str], options: FetchOptions) -> tuple[str, int, dict[str, str], bytes]:
    """The standard library's client. An HTTP error status is a result, not a failure."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    until = time.monotonic() + options.total_timeout
    try:
        # Bounds the connection and each wait for bytes; the whole reply is bounded below.
        reply = urlopen(Request(url, headers={"User-Agent": options.user_agent, **headers}), timeout=min(options.connect_timeout, options.total_timeout))  # noqa: S310
    except HTTPError as error:
        reply = error
    with reply:
        body = b""
        while len(body) <= options.max_bytes and (part := reply.read(min(1 << 16, options.max_bytes + 1 - len(body)))):
            body += part
            if time.monotonic() > until:
                raise TimeoutError(f"no whole reply within {options.total_timeout} s")
        return reply.geturl(), reply.status, dict(reply.headers.items()), body


def fetch(requests: DataFrame, transport: Transport = http_transport, options: FetchOptions = FetchOptions(), partition_by: str | None = None) -> DataFrame:
    """A result row a request (url, headers map): retried ``retries`` times after min(0.25 · 2**k, 5) s; status 0 and an error if all fail.

    Bodies are cut to ``max_bytes``. A task has up to ``connections`` requests under way at a time, and rows keep their order. ``partition_by`` keeps the requests of one host in one task, which is what politeness needs.
    """
    rows = requests.repartition(partition_by) if partition_by else requests

    def one(url: str, headers) -> tuple:
        began, error = time.monotonic(), None
        result = (url, 0, {}, b"")
        for attempt in range(options.retries + 1):
            try:
                result, error = transport(url, dict(headers or {}), options), None
                break
            except Exception as failure:
                error = f"{type(failure).__name__}: {failure}"
                if attempt < options.retries:
                    time.sleep(min(options.backoff_seconds * 2**attempt, options.backoff_cap))
        final, status, got, body = result
        kind = next((v for k, v in got.items() if k.lower() == "content-type"), None)
        return url, final, status, got, body[: options.max_bytes], kind, time.monotonic() - began, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, options.connections)) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch["url"], batch["headers"])), columns=[c.split()[0] for c in RESULT.split(", ")])

    return rows.select("url", "headers").mapInPandas(run, RESULT)


def is_ok(status, error):
    """A result with a status of 200..299 and no error."""
    return error.isNull() & status.between(200, 299)


def capped(raw, max_bytes: int):
    """The first ``max_bytes`` bytes of a binary column."""
    return F.substring(raw, 1, max_bytes)
