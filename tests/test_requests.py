"""Bodies of requests, the order of cache and bucket, bounds of both, and CSS variables."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from weftline.operators import requests as Q


def test_bodies(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_BODY", 300)
    bodies = [
        json.dumps({"url": " https://a.example "}), json.dumps({"image": " AAA ", "imageName": "n", "images": [{"data": str(k)} for k in range(8)], "mode": "palette", "forceRefresh": True}),
        json.dumps({"url": "  ", "images": []}), json.dumps({"url": "x", "mode": ""}), "{", "", None, "[1]", "3", json.dumps({"url": "é" * 200}), json.dumps({"images": None, "image": "Z"}),
    ]
    rows = Q.read_bodies(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).orderBy("id").collect()
    assert [r.status for r in rows] == [None, None, 400, None, 400, 400, 400, 400, 400, 413, None]
    assert [x.data for x in rows[1].images] == ["AAA", "0", "1", "2", "3", "4"] and rows[1].images[0].name == "n" and rows[1].force and rows[1].mode == "palette"
    assert rows[0].url == "https://a.example" and rows[0].mode == rows[3].mode == "both" and rows[9].cache_key is None
    assert rows[1].cache_key == hashlib.sha256(b":AAA|0|1|2|3|4:palette").hexdigest() and rows[0].cache_key == hashlib.sha256(b"https://a.example::both").hexdigest()


def test_order_of_cache_and_bucket(spark):
    rows = [(0, k, "c", f"k{k}", 0, False, True) for k in range(20)]  # the bucket is empty after these
    rows += [(0, 20, "c", "k3", 1, False, True), (0, 21, "c", "k3", 2, True, True), (0, 22, "c", "new", 3, None, None), (0, 23, "d", "new", 4, False, False), (0, 24, "d", "new", 5, False, True), (0, 25, "d", "new", 6, False, True)]
    rows += [(0, 26, "d", "k3", 600_001, False, True), (1, 27, "c", "k3", 3, False, True)]
    random.Random(1).shuffle(rows)
    schema = "store long, request_id long, client string, cache_key string, ts_ms long, force boolean, stored boolean"
    got = {r.request_id: (r.outcome, r.retry_after_s) for r in Q.served(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k][0] for k in range(20, 28)] == ["hit", "limited", "limited", "rendered", "rendered", "hit", "rendered", "rendered"]
    assert got[21][1] == 3 and all(got[k] == ("rendered", 0) for k in range(20))
    assert Q.served(spark.createDataFrame([], schema)).count() == 0


def test_buckets_are_bounded():
    b = Q.Buckets(3)
    for _ in range(20):
        assert b.take("a", 0)[0]
    assert not b.take("a", 0)[0]
    for k, c in enumerate("bcd"):  # the third takes the place of a, which was used least recently
        b.take(c, k + 1)
    assert set(b.held) == {"b", "c", "d"} and b.take("a", 4)[0] and set(b.held) == {"c", "d", "a"}
    b.take("e", 70_000)
    assert set(b.held) == {"e"}
    free, bound = Q.Buckets(10**9), Q.Buckets(4)  # idle buckets are full again: without more than four busy clients the bound changes nothing
    rng, now = random.Random(3), 0
    for _ in range(3000):
        now += rng.choice((0, 10, 500, 61_000))
        c = rng.randrange(4)
        assert free.take(c, now) == bound.take(c, now)


def test_variables_and_policy(spark):
    rows = [("var(--a) 1px", "4px 1px"), ("var( --b , red )", "red"), ("var(--c)", "4px"), ("x var(--no) y", "x var(--no) y"), ("rgb(1, 2, 3)", "rgb(1, 2, 3)"), ("var(--no, var(--a))", "4px"), ("var(--e,)|var(--a)", "|4px"), ("", ""), (None, None), ("var(--loop)", "var(--loop)"), ("$1 var(--d) \\", "$1 $0\\ \\")]
    props = F.create_map(*(F.lit(x) for x in ("--a", " 4px", "--c", "var(--a)", "--loop", "var(--loop)", "--b", " ", "--d", "$0\\")))
    df = spark.createDataFrame(rows, "value string, want string").withColumn("got", Q.resolved_variables(F.col("value"), props)).withColumn("plain", Q.resolved_variables(F.col("value"), F.lit(None).cast("map<string,string>")))
    assert [r.got for r in df.collect()] == [w for _, w in rows] and df.first().plain == "var(--a) 1px"
    cases = spark.createDataFrame([(None, True, True), ("flake", True, True), ("no key", True, False), ("failed", False, False), ("", None, None), ("failed", None, None)], "failure string, image boolean, lane boolean")
    assert [r[0] for r in cases.select(Q.cacheable(F.col("failure"), F.col("image"), F.col("lane"))).collect()] == [True, False, True, False, True, False]
