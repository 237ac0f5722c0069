"""Replay of an access log against the cache's freshness rules, without sharing between addresses.

The decision on a request depends on the page's earlier ones, so this is an ordered fold; each task streams its rows sorted by
page with one page's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.pages import LEASE_GROWTH, RING, TTL_LEAST_MS, TTL_MOST_MS, TTL_MS


def _ttl(times: list[int]) -> int:
    """Half the mean positive gap of the newest versions, within bounds."""
    gaps = [b - a for a, b in zip(times, times[1:]) if b > a]
    if len(times) < 3 or not gaps:
        return TTL_MS
    return int(max(TTL_LEAST_MS, min(TTL_MOST_MS, (sum(gaps) / len(gaps) / 2 + 0.5) // 1)))


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key: str | None = None
    digest: str | None = None
    created = ttl = 0
    times: list[int] = []
    for batch in batches:
        states, ttls = [], []
        for page, at, body in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if page != key:
                key, digest, times = page, None, []
            if digest is not None and at - created < ttl:
                state = "hit"
            elif digest is not None and body is None:
                state, created, ttl = "revalidated", at, int(min(TTL_MOST_MS, (ttl * LEASE_GROWTH + 0.5) // 1))
            else:
                state, ttl, created = "miss", _ttl(times), at
                if body != digest:
                    times = [*times, at][-RING:]
                digest = body if body is not None else digest or ""
            states.append(state)
            ttls.append(ttl)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(states, pa.string()), pa.array(ttls, pa.int64())], ["url_hash", "seq", "state", "ttl_ms"])


def replay(requests: DataFrame) -> DataFrame:
    """(url_hash, seq, state, ttl_ms): state is `hit`, `revalidated` or `miss`, ttl_ms the freshness after the request.

    `requests` has (url_hash, at_ms, seq, digest): the digest of what the origin would give, null for `not modified`.
    """
    rows = requests.filter("at_ms is not null and url_hash is not null").select("url_hash", "at_ms", "seq", "digest").repartition("url_hash").sortWithinPartitions("url_hash", "at_ms", "seq")
    return rows.mapInArrow(_replay, "url_hash string, seq long, state string, ttl_ms long")
