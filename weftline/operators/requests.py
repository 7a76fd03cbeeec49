"""Requests of the service as tables: bodies read and judged, then served from cache and token buckets in time order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.streaming.limiter import CAPACITY, ENTRIES, TTL_MS, WINDOW_MS, look_up, spend

#: Bytes of a body, and images of a request.
MAX_BODY, MAX_IMAGES = 48 * 1024 * 1024, 6
#: Clients whose buckets are held.
CLIENTS = 50_000

BODY = "url string, image string, imageName string, images array<struct<data:string,name:string>>, mode string, forceRefresh boolean"
OUTCOMES = "store long, request_id long, outcome string, retry_after_s int"


def read_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """The given columns with url, images, mode, force, cache_key and status.

    status is 413 for a body of more than MAX_BODY bytes, 400 for one that is no JSON object or names neither a URL nor an image, else
    null. The old field `image` comes before `images`; the first MAX_IMAGES count. cache_key is the SHA-256 of URL, images and mode;
    it is null where there is a status. A null body counts as empty.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    fits = F.octet_length(text) <= MAX_BODY
    rows = requests.withColumn("_object", fits & F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))).withColumn("_fits", fits)
    rows = rows.withColumn("_b", F.when(F.col("_object"), F.from_json(text, BODY)))
    single = F.trim(F.coalesce("_b.image", F.lit("")))
    none = F.array().cast("array<struct<data:string,name:string>>")
    alias = F.when(single != "", F.array(F.struct(single.alias("data"), F.col("_b.imageName").alias("name")))).otherwise(none)
    rows = rows.withColumn("url", F.nullif(F.trim("_b.url"), F.lit(""))).withColumn("images", F.slice(F.concat(alias, F.coalesce("_b.images", none)), 1, MAX_IMAGES))
    rows = rows.withColumn("mode", F.coalesce(F.nullif("_b.mode", F.lit("")), F.lit("both"))).withColumn("force", F.coalesce("_b.forceRefresh", F.lit(False)))
    status = F.when(~F.col("_fits"), 413).when(~F.col("_object") | (F.col("url").isNull() & (F.size("images") == 0)), 400)
    rows = rows.withColumn("status", status)
    key = F.concat(F.coalesce("url", F.lit("")), F.lit(":"), F.array_join(F.transform("images", lambda x: x["data"]), "|"), F.lit(":"), F.col("mode"))
    return rows.withColumn("cache_key", F.when(F.col("status").isNull(), F.sha2(key, 256))).drop("_b", "_object", "_fits")


def cacheable(failure: Column, is_image: Column, lane_open: Column) -> Column:
    """L4: a response is stored unless its structure failed in a way that may pass; for images without an open lane the failure lasts, so it is stored."""
    return F.coalesce(failure, F.lit("")).eqNullSafe("") | (F.coalesce(is_image, F.lit(False)) & ~F.coalesce(lane_open, F.lit(False)))


class Buckets:
    """L1, L2: token buckets by client. Where `most` are held, idle ones go first, then the one used least recently; who comes back starts full."""

    def __init__(self, most: int = CLIENTS):
        self.most, self.held = most, {}

    def take(self, client, now_ms: int) -> tuple[bool, int]:
        """Whether the client's request passes, and the seconds to wait where it does not."""
        tokens, last = self.held.pop(client, (float(CAPACITY), now_ms))
        if len(self.held) >= self.most:
            for c in [c for c, (_, at) in self.held.items() if now_ms - at >= WINDOW_MS]:
                del self.held[c]
            while len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
        tokens, passes, wait = spend(tokens, last, now_ms)
        self.held[client] = (tokens, max(last, now_ms))
        return passes, wait


class Service:
    """One process: its cache and its buckets, both bounded."""

    def __init__(self, ttl_ms: int = TTL_MS, entries: int = ENTRIES, clients: int = CLIENTS):
        self.ttl, self.entries, self.cache, self.buckets = ttl_ms, entries, {}, Buckets(clients)

    def serve(self, client, key, now_ms: int, force: bool, stored: bool) -> tuple[str, int]:
        """(hit, limited or rendered, seconds to wait). A hit costs no token; a forced request does not look; what is rendered is stored if it may be."""
        expires = self.cache.get(key)
        if not force and expires is not None and now_ms <= expires:
            look_up(self.cache, key, now_ms, self.ttl, self.entries)
            return "hit", 0
        if not force:
            self.cache.pop(key, None)
        passes, wait = self.buckets.take(client, now_ms)
        if not passes:
            return "limited", wait
        if stored:
            self.cache.pop(key, None)
            look_up(self.cache, key, now_ms, self.ttl, self.entries)
        return "rendered", 0


def served(requests: DataFrame, ttl_ms: int = TTL_MS, entries: int = ENTRIES, clients: int = CLIENTS) -> DataFrame:
    """L4: store, request_id, outcome, retry_after_s of requests store, request_id, client, cache_key, ts_ms, force, stored.

    A store is one process with one cache and one set of buckets, so its requests are folded in time order (then by request_id) as a
    stream of batches; stores run side by side and no store is ever held. Null force counts as false, null stored as true.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, service = None, None
        for batch in batches:
            got = []
            for s, _, client, key, now, force, stored in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if service is None or s != store:
                    store, service = s, Service(ttl_ms, entries, clients)
                got.append(service.serve(client, key, now, bool(force), stored is not False))
            columns = [batch.column(0), batch.column(1), pa.array([o for o, _ in got], pa.string()), pa.array([w for _, w in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["store", "request_id", "outcome", "retry_after_s"])

    rows = requests.select(F.col("store").cast("long"), F.col("request_id").cast("long"), "client", "cache_key", F.col("ts_ms").cast("long"), "force", "stored")
    return rows.repartition("store").sortWithinPartitions("store", "ts_ms", "request_id").mapInArrow(run, OUTCOMES)


def resolved_variables(value: Column, properties: Column, passes: int = 3) -> Column:
    """A CSS value with var(--name, fallback) replaced by the property (a map), else by the fallback; else it stays as it is.

    Every pass replaces all references that hold no parentheses of their own; null values stay null, a null map has no properties.
    """
    reference = r"var\(\s*(--[a-zA-Z0-9_-]+)\s*(?:,\s*([^()]*))?\)"
    known = F.coalesce(properties, F.create_map().cast("map<string,string>"))

    def put(text: Column) -> Column:
        between = F.split(text, reference, -1)

        def found(ref: Column) -> Column:
            name = F.regexp_extract(ref, reference, 1)
            fallback = F.when(F.contains(ref, F.lit(",")), F.trim(F.regexp_extract(ref, reference, 2)))
            return F.coalesce(F.nullif(F.trim(F.element_at(known, name)), F.lit("")), fallback, ref)

        given = F.transform(F.regexp_extract_all(text, F.lit(reference), F.lit(0)), found)
        return F.array_join(F.zip_with(between, given, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), value, lambda text, _: F.when(F.contains(text, F.lit("var(")), put(text)).otherwise(text))
