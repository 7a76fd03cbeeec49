"""Request state: token bucket and cache, as a batch fold in time order and as a stateful stream.

The bucket holds CAPACITY tokens and refills evenly over WINDOW_MS; a request spends one or is rejected with the seconds until one is
there. The state of a client is its tokens and the time of its last request.

The cache holds ENTRIES responses. A response is stored on a miss and served for TTL_MS from then on, however often it is read; a read
only makes its item the most recently used. Where the cache is full, what has expired goes first, then what was used least recently.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 20
WINDOW_MS = 60_000
#: A cached response is served for TTL_MS.
TTL_MS = 600_000
#: Responses that a cache holds.
ENTRIES = 50

DECISIONS = "client long, request_id long, ts_ms long, allowed boolean, tokens double, retry_after_s int"


def spend(tokens: float, last_ms: int, now_ms: int) -> tuple[float, bool, int]:
    """(tokens left, allowed, seconds to wait) of a request; time never runs backwards."""
    rate = CAPACITY / WINDOW_MS
    tokens = min(float(CAPACITY), tokens + max(0, now_ms - last_ms) * rate)
    if tokens >= 1:
        return tokens - 1, True, 0
    return tokens, False, math.ceil((1 - tokens) / rate / 1000)


def _fold(rows, tokens: float, last: int | None):
    out = []
    for client, request, now in rows:
        tokens, allowed, wait = spend(tokens, now if last is None else last, now)
        last = now if last is None else max(last, now)
        out.append((client, request, now, allowed, round(tokens, 6), wait))
    return out, tokens, last


def limit(requests: DataFrame) -> DataFrame:
    """Decisions for client, request_id, ts_ms. A client's requests are folded in batches of its sorted rows, so a busy client is streamed and never held."""

    def run(batches):
        import pyarrow as pa

        client, tokens, last = None, float(CAPACITY), None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if row[0] != client:
                    client, tokens, last = row[0], float(CAPACITY), None
                got, tokens, last = _fold([row], tokens, last)
                out += got
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int32()]
            names = ["client", "request_id", "ts_ms", "allowed", "tokens", "retry_after_s"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    return requests.select("client", "request_id", "ts_ms").repartition("client").sortWithinPartitions("client", "ts_ms", "request_id").mapInArrow(run, DECISIONS)


def limit_stream(requests: DataFrame) -> DataFrame:
    """The same on a stream. The state of a client is two numbers; it is kept for good, as a client without requests looks like a new one only after a window."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        tokens, last = state.get if state.exists else (float(CAPACITY), -1)
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "request_id"])
        out, tokens, last = _fold(rows[["client", "request_id", "ts_ms"]].itertuples(index=False, name=None), tokens, None if last < 0 else last)
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["client", "request_id", "ts_ms", "allowed", "tokens", "retry_after_s"])

    return requests.groupBy("client").applyInPandasWithState(step, DECISIONS, "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def requests_of(events: DataFrame) -> DataFrame:
    """Events as requests; a day is taken as an hour, so that clients reach their limit."""
    return events.select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), (F.unix_millis(F.col("ts").cast("timestamp")) / 24).cast("long").alias("ts_ms"))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1."""
    return limit(requests_of(spark.read.parquet(f"{sf_dir}/events.parquet")))


HITS = "store long, client long, item string, event_id long, hit boolean"


def look_up(held: dict, key, now_ms: int, ttl_ms: int = TTL_MS, entries: int = ENTRIES) -> bool:
    """Whether the key is served from `held` (key -> last time it is served, the least recently used first), which is updated; a miss is stored."""
    expires = held.pop(key, None)
    if expires is not None and now_ms <= expires:
        held[key] = expires
        return True
    if len(held) >= entries:
        for k in [k for k, e in held.items() if now_ms > e]:
            del held[k]
        while len(held) >= entries:
            del held[next(iter(held))]
    held[key] = now_ms + ttl_ms
    return False


def cached(requests: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """Hits of requests store, client, item, event_id, ts_ms; a store is one cache. Its sorted rows are folded in batches and never held."""

    def run(batches):
        import pyarrow as pa

        store, held = None, {}
        for batch in batches:
            hits = []
            for s, client, item, now in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 4)], strict=True):
                if s != store:
                    store, held = s, {}
                hits.append(look_up(held, (client, item), now, ttl_ms))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(hits, pa.bool_())], names=["store", "client", "item", "event_id", "hit"])

    return requests.select("store", "client", "item", "event_id", "ts_ms").repartition("store").sortWithinPartitions("store", "ts_ms", "event_id").mapInArrow(run, HITS)


def cached_stream(requests: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """The same on a stream. The state of a store is its entries in the order of their last use."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        held = {(c, i): e for c, i, e in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "event_id"])
        hits = [look_up(held, (c, i), now, ttl_ms) for c, i, now in rows[["client", "item", "ts_ms"]].itertuples(index=False, name=None)]
        state.update(([int(c) for c, _ in held], [i for _, i in held], [int(e) for e in held.values()]))
        yield rows[["store", "client", "item", "event_id"]].assign(hit=hits)

    return requests.groupBy("store").applyInPandasWithState(step, HITS, "clients array<long>, items array<string>, expires array<long>", "append", GroupStateTimeout.NoTimeout)


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: one cache for all clients, as in the reference, so one task folds all requests; an item is asked for by a client."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.lit(0).cast("long").alias("store"), F.col("user_id").alias("client"), F.col("event_type").alias("item"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return cached(rows, TTL_MS * 6 * 24).drop("store")


def statuses(d) -> str:
    """Body limit and status of a request."""
    return f"SELECT conv_id, turn, CASE WHEN text IS NULL OR length(text) = 0 THEN 400 WHEN length(text) > 1000 THEN 413 WHEN role NOT IN ('user', 'assistant', 'system') THEN 422 ELSE 200 END AS status FROM {d.t('conversations')}"


PLANS = {"l6_statuses": statuses}
FUNCTIONS = {"l1_token_bucket": token_bucket, "l3_cache_hits": cache_hits}
