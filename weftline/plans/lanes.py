"""Queries of role attribution and of model answers over the test tables, each with SQL of its own that states the outcome of every case."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import answers as A
from weftline.operators import attribution as R
from weftline.operators import requests as Q

#: Colours of the made nodes, far from each other; the first five have a role.
FAMILIES = ("#f8f8f0", "#2050c0", "#303030", "#c03020", "#20a060", "#e0a0e0", "#808000")
ROLES = ("background", "primary", "text", "danger", "accent")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, at):
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style nodes of users: colours a step off the family's, written in three ways."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    family = F.col("k") % len(FAMILIES)
    parts = [_pick([int(h[i : i + 2], 16) for h in FAMILIES], family) for i in (1, 3, 5)]
    off = F.concat(parts[0], F.lit(", "), parts[1], F.lit(", "), parts[2] + 1)
    css = F.when(F.col("k") % 3 == 0, F.upper(_pick(FAMILIES, family))).when(F.col("k") % 3 == 1, F.concat(F.lit("rgb("), off, F.lit(")"))).otherwise(F.concat(F.lit("rgba("), off, F.lit(", 0.5)")))
    color = lambda channel, value: F.struct(F.lit(channel).alias("channel"), value.alias("value"))
    ink = F.upper(_pick(FAMILIES, F.floor(F.col("k") / 7) % len(FAMILIES)))
    colors = F.when(F.col("event_type") == "click", F.array(color("text", ink), color("background", css))).when(F.col("event_type") == "view", F.array(color("background", css))).otherwise(F.array(color("border", css)))
    change = lambda name, old, new: F.struct(F.lit(name).alias("property"), old.alias("from"), new.alias("to"))
    state = lambda name, *changes: F.struct(F.lit(name).alias("state"), F.array(*changes).alias("changes"))
    hover = state("hover", change("background-color", css, ink), change("box-shadow", F.lit("none"), F.concat(F.lit("0 "), F.col("k") % 4, F.lit("px"))))
    focus = state("focus-visible", change("outline", F.lit("none"), F.concat((F.col("k") % 5).cast("string"), F.lit("px"))))
    states = F.when(F.col("event_type") == "view", F.array(hover)).when(F.col("event_type") == "click", F.array(focus, hover))
    return e.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("ord"), colors.alias("colors"), states.alias("states"))


def _palette(nodes: DataFrame) -> DataFrame:
    swatches = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(h).alias("hex")) for r, h in zip(ROLES, FAMILIES, strict=False)))
    rows = nodes.select("capture_id").distinct().select("capture_id", F.posexplode(swatches).alias("ord", "s"))
    return rows.select("capture_id", "ord", "s.role", "s.hex")


def nearest(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select("capture_id", R.base_color().alias("css"))
    return R.nearest_roles(nodes, _palette(nodes)).groupBy("css", "role").agg(F.count(F.lit(1)).alias("captures"))


def states(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    rows = R.role_states(nodes, _palette(nodes)).select("capture_id", "target", "state", F.posexplode("changes").alias("at", "c"))
    return rows.select("capture_id", "target", "state", "c.property", F.col("c.from").alias("old"), F.col("c.to").alias("new"))


def on_primary(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return R.on_primary(nodes, _palette(nodes))


MOVES = (
    [("#222222", "accent")], [("#111111", "border")], [("#AAAAAA", "primary")], [("#dddddd", "primary")], [("#777777", "surface"), ("#ffffff", "text")],
    [("#333333", "primary"), ("#111111", "text")], [("#111111", "primary")],
)


def moves(spark, sf_dir):
    k = F.col("c_custkey")
    swatches = [("#ffffff", "background"), ("#111111", "primary"), ("#222222", "text"), ("#333333", "danger"), ("#aaaaaa", None), ("#dddddd", "accent"), ("#dddddd", "muted")]
    text = "CAST(NULL AS STRING)"
    colors = F.array(*(F.struct(F.lit(h).alias("hex"), F.expr(f"'{r}'" if r else text).alias("role"), F.expr(text).alias("name"), F.expr(text).alias("usage")) for h, r in swatches))
    made = F.array(*(F.array(*(F.struct(F.lit(h).alias("hex"), F.lit(r).alias("role")) for h, r in m)) for m in MOVES))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", A.refined(colors, F.get(made, (k % len(MOVES)).cast("int"))).alias("x"))
    show = F.array_join(F.transform("x.colors", lambda c: F.concat(F.substring(c["hex"], 2, 1), F.lit(":"), F.coalesce(c["role"], F.lit("-")))), " ")
    return rows.select("c_custkey", show.alias("roles"), F.size("x.changes").cast("int").alias("changes"))


def interpreted(spark, sf_dir):
    k = F.col("s_suppkey") % 6
    good = {"identity": {"adjectives": ["soft", "airy", "plain"], "archetype": "shop", "description": "d"}, "imageMood": {"hero": ["sea"], "texture": ["sand"]}}
    other = good | {"identity": good["identity"] | {"archetype": "blog"}, "roleRefinements": [{"hex": "#aabbcc", "role": "text"}]}
    wrong = good | {"roleRefinements": [{"hex": "#aabbcc", "role": "danger"}]}
    first = F.when(k == 0, json.dumps(good)).when(k == 1, "refused").when(k == 2, json.dumps(wrong)).when(k == 3, "{").when(k == 4, "Here: " + json.dumps(other) + ".")
    second = F.when(k == 1, json.dumps(other)).when(k == 2, json.dumps(wrong)).otherwise(json.dumps(good))
    s = _read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "capture_id").withColumn("s_suppkey", F.col("capture_id"))
    rows = s.select("capture_id", F.posexplode(F.array(first, second, F.lit(json.dumps(good)))).alias("place", "text"), F.when(k == 3, "429").alias("error"))
    got = A.interpretations(rows.select("capture_id", (F.col("place") + 1).alias("attempt"), "text", F.when(F.col("place") == 1, F.col("error")).alias("error")))
    return got.select("capture_id", "archetype", F.array_join("adjectives", ",").alias("adjectives"), F.size("refinements").cast("int").alias("moves"))


def stability(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("capture_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))
    k, run = F.col("capture_id") % 4, F.col("run")
    words = F.when(k == 0, F.array(F.lit("Calm "), F.lit("bold"))).when(k == 1, F.array(F.lit("calm"), F.concat(F.lit("b"), run.cast("string")))).otherwise(F.array(F.lit("calm"), F.lit("bold"), F.lit("dry")))
    kind = F.when((k == 2) & (run == 2), "news site").when(k == 2, "Site: shop").when(k == 3, "!").otherwise("Dev-tool")
    got = A.stability(c.filter((k != 3) | (run < 3)).select("capture_id", "run", words.alias("adjectives"), kind.alias("archetype")))
    return got.select("capture_id", F.round("adjectives", 9).alias("adjectives"), F.round("archetype", 9).alias("archetype"), "ok")


def renamed(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    parts = lines.groupBy(F.col("l_orderkey").alias("capture_id"), F.concat(F.lit("node-"), "l_linenumber").alias("id")).agg(F.lit("Block").alias("name"), F.lit("container").alias("kind"))
    orders = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    updates = orders.select(F.col("o_orderkey").alias("capture_id"), F.posexplode(F.array(F.lit("node-1"), F.lit("node-2"), F.lit("node-1"), F.lit("node-99"))).alias("place", "id"))
    updates = updates.withColumn("name", F.concat(F.lit("Part"), F.col("place").cast("string"))).withColumn("kind", F.lit("region"))
    return A.renamed(parts, updates).groupBy("id", "name", "kind", "naming").agg(F.count(F.lit(1)).alias("n"))


def bodies(spark, sf_dir):
    k = F.col("o_orderkey")
    made = F.when(k % 5 == 0, F.concat(F.lit('{"url": " https://h'), k % 9, F.lit('.example "}'))).when(k % 5 == 1, F.concat(F.lit('{"image": " I'), k % 9, F.lit('", "images": [{"data": "A"}, {"data": "B"}], "mode": "palette"}')))
    made = made.when(k % 5 == 2, '{"url": " ", "images": []}').when(k % 5 == 3, F.concat(F.lit("{"), F.col("o_orderpriority"))).otherwise(F.concat(F.lit('{"images": ['), F.array_join(F.array_repeat(F.lit('{"data": "x"}'), (k % 9).cast("int")), ", "), F.lit("]}")))
    rows = Q.read_bodies(_read(spark, sf_dir, "orders").select("o_orderkey", made.alias("body")))
    return rows.select("o_orderkey", "url", F.size("images").cast("int").alias("images"), "mode", F.col("status").cast("int").alias("status"), "cache_key")


def variables(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, "var(--pad) solid").when(k % 4 == 1, F.concat(F.lit("calc(var(--none, "), k % 7, F.lit("px) + 1px)"))).when(k % 4 == 2, "var(--none)").otherwise("var(--outer, var(--pad))")
    props = F.create_map(F.lit("--pad"), F.concat(F.lit(" "), k % 5, F.lit("px")), F.lit("--outer"), F.when(k % 3 == 0, "var(--pad)").otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", Q.resolved_variables(value, props).alias("value"))


def served(spark, sf_dir):
    """L4: requests of users to eight processes; the event type is what they ask for, an error is not stored, a purchase is forced."""
    e = _read(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 8).alias("store"), F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), F.concat("user_id", F.lit(":"), "event_type").alias("cache_key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") == "purchase").alias("force"), (F.col("event_type") != "error").alias("stored"))
    return Q.served(rows)


QUERIES = {
    "a14_request_bodies": bodies, "i7_css_variables": variables, "l4_served": served,
    "c2_nearest_role": nearest, "c14_role_states": states, "c15_on_primary": on_primary, "m4_role_moves": moves, "m3_interpretations": interpreted, "n5_stability": stability, "m6_renamed": renamed,
}

_LIST = "[" + ", ".join(f"'{h}'" for h in FAMILIES) + "]"
_OFF = "[" + ", ".join(f"'{', '.join(str(int(h[i : i + 2], 16) + (i == 5)) for i in (1, 3, 5))}'" for h in FAMILIES) + "]"
_NODES = f"""
n AS (SELECT user_id, event_id, event_type, k, k % 7 AS family, list_extract({_LIST}, CAST(k // 7 % 7 AS INTEGER) + 1) AS ink, list_extract(['background', 'primary', 'text', 'danger', 'accent'], CAST(k % 7 AS INTEGER) + 1) AS role,
  CASE k % 3 WHEN 0 THEN upper(list_extract({_LIST}, CAST(k % 7 AS INTEGER) + 1)) WHEN 1 THEN 'rgb(' || list_extract({_OFF}, CAST(k % 7 AS INTEGER) + 1) || ')' ELSE 'rgba(' || list_extract({_OFF}, CAST(k % 7 AS INTEGER) + 1) || ', 0.5)' END AS css
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e)"""
_SHOWN = "CASE k % 3 WHEN 0 THEN list_extract(" + _LIST + ", CAST(family AS INTEGER) + 1) ELSE list_extract([" + ", ".join(f"'{h[:5]}{int(h[5:], 16) + 1:02x}'" for h in FAMILIES) + "], CAST(family AS INTEGER) + 1) END"

ORACLES = {
    "c2_nearest_role": f"""
WITH {_NODES}
SELECT css, role, count(DISTINCT user_id) AS captures FROM n WHERE role IS NOT NULL GROUP BY 1, 2""",
    "a14_request_bodies": """
WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 0 THEN 'https://h' || (o_orderkey % 9) || '.example' END AS url, CASE o_orderkey % 5 WHEN 1 THEN 3 WHEN 4 THEN least(6, o_orderkey % 9) ELSE 0 END AS images FROM orders)
SELECT o_orderkey, url, CAST(images AS INTEGER) AS images, CASE k WHEN 1 THEN 'palette' ELSE 'both' END AS mode, CASE WHEN url IS NULL AND images = 0 THEN 400 END AS status,
  CASE WHEN url IS NOT NULL THEN sha256(url || '::both') WHEN k = 1 THEN sha256(':I' || (o_orderkey % 9) || '|A|B:palette') WHEN images > 0 THEN sha256(':' || array_to_string(list_transform(range(0, images), lambda i: 'x'), '|') || ':both') END AS cache_key FROM r""",
    "i7_css_variables": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 5) || 'px solid' WHEN 1 THEN 'calc(' || (p_partkey % 7) || 'px + 1px)' WHEN 2 THEN 'var(--none)' ELSE (p_partkey % 5) || 'px' END AS value FROM part""",
    "c14_role_states": f"""
WITH {_NODES}, c AS (
  SELECT user_id, event_id, role, 'hover' AS state, 'background-color' AS property, {_SHOWN} AS old, css AS raw, ink AS new FROM n WHERE event_type IN ('view', 'click') AND role IS NOT NULL
  UNION ALL SELECT user_id, event_id, role, 'hover', 'box-shadow', 'none', 'none', '0 ' || (k % 4) || 'px' FROM n WHERE event_type IN ('view', 'click') AND role IS NOT NULL
  UNION ALL SELECT user_id, event_id, role, 'focus-visible', 'outline', 'none', 'none', (k % 5) || 'px' FROM n WHERE event_type = 'click' AND role IS NOT NULL
), g AS (SELECT user_id, role, state, property, raw, any_value(old) AS old, new, count(*) AS n, min(event_id) AS first FROM c GROUP BY user_id, role, state, property, raw, new)
SELECT user_id AS capture_id, role AS target, state, property, old, new FROM g QUALIFY row_number() OVER (PARTITION BY user_id, role, state, property ORDER BY n DESC, first) = 1""",
    "c15_on_primary": f"""
WITH {_NODES}, g AS (SELECT user_id, ink, count(*) AS n, min(event_id) AS first FROM n WHERE event_type = 'click' AND role = 'primary' GROUP BY 1, 2),
b AS (SELECT user_id, ink FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1)
SELECT u.user_id AS capture_id, coalesce(ink, '#ffffff') AS hex, ink IS NULL AS inferred FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON u.user_id = b.user_id""",
    "m4_role_moves": """
WITH m(i, roles, changes) AS (VALUES
  (0, 'f:background d:text 1:primary 2:accent d:muted 3:danger a:-', 1), (1, 'f:background 2:text d:accent d:muted 1:border 3:danger a:-', 1), (2, 'f:background 2:text a:primary d:accent d:muted 3:danger 1:-', 1),
  (3, 'f:background 2:text 1:primary d:accent d:muted 3:danger a:-', 0), (4, '2:background f:text 1:primary d:accent d:muted 3:danger a:-', 1), (5, 'f:background 1:text 3:primary d:accent d:muted 2:- a:-', 2),
  (6, 'f:background 2:text 1:primary d:accent d:muted 3:danger a:-', 0))
SELECT c_custkey, roles, CAST(changes AS INTEGER) AS changes FROM customer JOIN m ON c_custkey % 7 = i""",
    "m3_interpretations": """
SELECT s_suppkey AS capture_id, CASE WHEN s_suppkey % 6 IN (0, 5) THEN 'shop' ELSE 'blog' END AS archetype, 'soft,airy,plain' AS adjectives, CAST(s_suppkey % 6 IN (1, 4) AS INTEGER) AS moves FROM supplier WHERE s_suppkey % 6 NOT IN (2, 3)""",
    "n5_stability": """
SELECT c_custkey AS capture_id, CASE c_custkey % 4 WHEN 1 THEN round(1.0::DOUBLE / 3, 9) ELSE 1.0::DOUBLE END AS adjectives, CASE c_custkey % 4 WHEN 2 THEN round((1.0::DOUBLE / 3 + 1 + 1.0::DOUBLE / 3) / 3, 9) ELSE 1.0::DOUBLE END AS archetype,
  c_custkey % 4 <> 1 AS ok FROM customer WHERE c_custkey % 4 <> 3""",
    "m6_renamed": """
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
j AS (SELECT l_linenumber, o_orderkey IS NOT NULL AS asked FROM p LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = l_orderkey)
SELECT 'node-' || l_linenumber AS id, CASE WHEN asked AND l_linenumber = 1 THEN 'Part2' WHEN asked AND l_linenumber = 2 THEN 'Part1' ELSE 'Block' END AS name,
  CASE WHEN asked AND l_linenumber <= 2 THEN 'region' ELSE 'container' END AS kind, CASE WHEN asked THEN 'ai' ELSE 'heuristic' END AS naming, count(*) AS n FROM j GROUP BY 1, 2, 3, 4""",
}
