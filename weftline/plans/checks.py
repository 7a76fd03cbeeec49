"""Queries of the scalar rules over the test tables, each with SQL of its own that states the rule anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import styles as S


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return rows.select("conv_id", F.array_join(S.spread(F.col("turns"), 4).cast("array<string>"), ",").alias("picked"))


def transitions(spark, sf_dir):
    k = F.col("p_size")
    p = _read(spark, sf_dir, "part").select("p_partkey", k)
    durations = F.concat((k % 4).cast("string"), F.lit("00ms, 0."), (k % 10).cast("string"), F.lit("s"))
    properties = F.when(k % 3 == 0, "color").when(k % 3 == 1, "color, transform").otherwise("")
    timings = F.when(k % 2 == 0, "cubic-bezier(0.1, 0.2, 0.3, 1), ease-in").otherwise("linear")
    delays = F.when(k % 5 == 0, "50ms").otherwise("0s, 1s")
    rows = p.select("p_partkey", F.posexplode(S.transitions(durations, properties, timings, delays)).alias("at", "t"))
    return rows.select("p_partkey", "t.property", F.round("t.duration_ms", 3).alias("duration_ms"), "t.timing", F.round("t.delay_ms", 3).alias("delay_ms"))


def borders(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 4).cast("double").alias("a"), (F.col("l_suppkey") % 3).cast("double").alias("b"), (F.col("l_orderkey") % 4).cast("double").alias("c"))
    side = lambda w, style, color: F.struct(w.alias("width"), style.alias("style"), color.alias("color"))
    sides = F.array(
        side(F.col("a"), F.when(F.col("l_linenumber") % 3 == 0, "none").otherwise("solid"), F.lit("top")), side(F.col("b"), F.lit("dashed"), F.when(F.col("l_linenumber") % 2 == 0, "right")),
        side(F.col("c"), F.when(F.col("l_linenumber") % 5 == 0, "hidden").otherwise("solid"), F.lit("bottom")), side(F.lit(1.0), F.lit("solid"), F.lit("left")),
    )
    return rows.groupBy(S.border_color(sides).alias("color"), S.semantic_context(F.when(F.col("l_linenumber") == 1, "status").otherwise("note"), (F.col("l_partkey") % 2 == 0).cast("string")).alias("context")).agg(F.count(F.lit(1)).alias("n"))


def signatures(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    kids = F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), lambda i: F.concat(F.lit("t"), (i % 3).cast("string")))
    own = S.signature(F.lower("l_returnflag"), kids, F.col("l_quantity") * 7.5, F.col("l_quantity") - 20.5)
    columns = S.columns_of(F.when(F.col("l_linestatus") == "O", "inline-grid").otherwise("flex"), F.concat(F.lit("1fr  "), F.repeat(F.lit("20px "), F.col("l_linenumber"))))
    return rows.groupBy(own.alias("signature"), columns.alias("columns")).agg(F.count(F.lit(1)).alias("n"))


def clients(spark, sf_dir):
    k = F.col("c_custkey")
    forwarded = F.when(k % 4 == 0, F.concat(F.lit(" 10.0.0."), (k % 200).cast("string"), F.lit(" , 9.9.9.9"))).when(k % 4 == 1, " ,8.8.8.8")
    real = F.when(k % 3 == 0, F.concat(F.lit(" 7.7.7."), (k % 9).cast("string"))).when(k % 3 == 1, "  ")
    return _read(spark, sf_dir, "customer").select("c_custkey", S.client_id(forwarded, real).alias("client"))


def images(spark, sf_dir):
    k = F.col("s_suppkey")
    head = F.when(k % 5 == 0, "/9j/4AAQSkZJRgAB").when(k % 5 == 1, "iVBORw0KGgoAAAAN").when(k % 5 == 2, "R0lGODlhAQABAIAA").when(k % 5 == 3, "UklGRiIAAABXRUJQ").otherwise("not an image")
    prefix = F.when(k % 3 == 0, "data:image/svg+xml;base64,").when(k % 3 == 1, "data:text/plain;base64,").otherwise("")
    image = S.without_data_url(F.concat(prefix, head))
    return _read(spark, sf_dir, "supplier").select("s_suppkey", image.alias("image"), S.media_type(image).alias("media_type"))


def settings(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, "junk").when(k % 6 == 2, "0.5").when(k % 6 == 3, "-3").when(k % 6 == 4, F.concat((k % 50).cast("string"), F.lit(".75"))).otherwise(F.concat(F.lit(" "), (k % 9).cast("string")))
    rows = _read(spark, sf_dir, "orders")
    return rows.groupBy(S.positive(raw, 20).alias("number"), S.positive_integer(raw, 20).alias("whole")).agg(F.count(F.lit(1)).alias("n"))


FONTS = ("RecifeText-SemiBold", "Söhne Buch", "GT Walsheim VF", "Circular Std Bold", "Inter", "Canela Light 2", "Recife Display", "Neue_Montreal-Medium", "Bold", "Founders Grotesk X-Condensed")


def fonts(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, FONTS)), (F.col("n_nationkey") % len(FONTS)).cast("int"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", S.font_key(name).alias("font_key"), S.font_substitute(name).alias("substitute"), S.css_font(name).alias("css"))


def scores(spark, sf_dir):
    """Sizes of users against a scale, site scores, gates and their mean."""
    e = _read(spark, sf_dir, "events")
    got = e.groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("token")).agg(F.max("value").alias("px"))
    got = got.withColumn("px", F.col("px") / 10)
    want = F.element_at(F.array(*(F.lit(float(x)) for x in (48, 46, 40, 30, 13))), F.col("token") + 1)
    per = got.groupBy("user_id").agg((F.count_if(S.size_matches(want, F.col("px"))) / 5.0).alias("typography"), F.count(S.mobile_size(want, F.col("px"))).alias("mobile"))
    per = per.select("user_id", "typography", "mobile", S.combined_score(F.lit(0.9), F.col("typography"), F.when(F.col("user_id") % 2 == 0, F.lit(1.0))).alias("combined"))
    per = per.withColumn("failure", S.gate(F.col("combined"), F.when(F.col("user_id") % 3 > 0, F.lit(0.9))))
    return per.groupBy("failure").agg(F.count(F.lit(1)).alias("n"), F.sum("mobile").alias("mobile"), S.percent(F.round(F.avg("combined"), 9)).alias("mean"))


def loose(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).when(k == 2, F.lit("no json {")).otherwise(F.concat(F.lit("{ broken "), "props"))
    rows = _read(spark, sf_dir, "events").select(F.get_json_object(S.loose_json(text), "$.k").cast("long").alias("k"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "a18_spread": spread, "i6_transitions": transitions, "b5_border_color": borders, "h17_signatures": signatures, "i29_client_ids": clients, "a11_media_types": images,
    "h18_settings": settings, "i18_font_names": fonts, "n2_scores": scores, "i24_loose_json": loose,
}

ORACLES = {
    "a18_spread": """
WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ix, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
w AS (SELECT conv_id, i, CASE WHEN n <= 4 THEN i ELSE CAST(floor(i * (n - 1) / 3.0 + 0.5) AS BIGINT) END AS ix FROM (SELECT DISTINCT conv_id, n FROM c), range(0, 4) r(i) WHERE i < n)
SELECT w.conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY w.i) AS picked FROM w JOIN c ON c.conv_id = w.conv_id AND c.ix = w.ix GROUP BY w.conv_id""",
    "i6_transitions": """
WITH p AS (SELECT p_partkey, p_size AS k FROM part), t AS (
  SELECT p_partkey, CASE k % 3 WHEN 2 THEN 'all' ELSE 'color' END AS property, CAST(k % 4 * 100 AS DOUBLE) AS duration_ms, CASE k % 2 WHEN 0 THEN 'cubic-bezier(0.1, 0.2, 0.3, 1)' ELSE 'linear' END AS timing, CASE k % 5 WHEN 0 THEN 50.0 ELSE 0.0 END AS delay_ms FROM p
  UNION ALL
  SELECT p_partkey, CASE k % 3 WHEN 2 THEN 'all' WHEN 1 THEN 'transform' ELSE 'color' END, CAST(k % 10 * 100 AS DOUBLE), CASE k % 2 WHEN 0 THEN 'ease-in' ELSE 'linear' END, CASE k % 5 WHEN 0 THEN 50.0 ELSE 1000.0 END FROM p
) SELECT p_partkey, property, duration_ms, timing, CAST(delay_ms AS DOUBLE) AS delay_ms FROM t WHERE duration_ms > 0""",
    "b5_border_color": """
WITH s AS (
  SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_partkey % 4 END AS t, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 3 ELSE 0 END AS r, CASE WHEN l_linenumber % 5 = 0 THEN 0 ELSE l_orderkey % 4 END AS b FROM lineitem
)
SELECT CASE WHEN t > 0 AND t >= r AND t >= b THEN 'top' WHEN r > 0 AND r >= b THEN 'right' WHEN b > 0 THEN 'bottom' ELSE 'left' END AS color,
       CASE WHEN l_linenumber = 1 THEN 'alert' WHEN l_partkey % 2 = 0 THEN 'invalid' END AS context, count(*) AS n
FROM s GROUP BY 1, 2""",
    "h17_signatures": """
SELECT lower(l_returnflag) || '[' || CASE l_linenumber WHEN 1 THEN 't1' WHEN 2 THEN 't1,t2' WHEN 3 THEN 't1,t2,t0' WHEN 4 THEN 't1,t2,t0,t1' ELSE 't1,t2,t0,t1,t2' END || ']_'
       || CAST(CAST(floor(l_quantity * 0.3 + 0.5) * 25 AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(floor((l_quantity - 20.5) / 25 + 0.5) * 25 AS BIGINT) AS VARCHAR) AS signature,
       CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber + 1 AS INTEGER) END AS columns, count(*) AS n
FROM lineitem GROUP BY 1, 2""",
    "i29_client_ids": """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '10.0.0.' || (c_custkey % 200) WHEN c_custkey % 3 = 0 THEN '7.7.7.' || (c_custkey % 9) ELSE 'unknown' END AS client FROM customer""",
    "a11_media_types": """
WITH i AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 1 THEN 'data:text/plain;base64,' ELSE '' END AS p, list_extract(['/9j/4AAQSkZJRgAB', 'iVBORw0KGgoAAAAN', 'R0lGODlhAQABAIAA', 'UklGRiIAAABXRUJQ', 'not an image'], CAST(s_suppkey % 5 AS INTEGER) + 1) AS h FROM supplier)
SELECT s_suppkey, p || h AS image, CASE WHEN p <> '' THEN 'image/png' ELSE list_extract(['image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/png'], CAST(s_suppkey % 5 AS INTEGER) + 1) END AS media_type FROM i""",
    "h18_settings": """
WITH v AS (SELECT CASE o_orderkey % 6 WHEN 2 THEN 0.5 WHEN 4 THEN o_orderkey % 50 + 0.75 WHEN 5 THEN o_orderkey % 9 ELSE 0 END AS x FROM orders)
SELECT CAST(CASE WHEN x > 0 THEN x ELSE 20 END AS DOUBLE) AS number, CAST(CASE WHEN x >= 1 THEN floor(x) ELSE 20 END AS BIGINT) AS whole, count(*) AS n FROM v GROUP BY 1, 2""",
    "i18_font_names": """
WITH f(i, font_key, substitute, css) AS (VALUES
  (0, 'recifetext', 'Plus Jakarta Sans', 'RecifeText-SemiBold'), (1, 'sohne', 'Inter', '"Söhne Buch"'), (2, 'gtwalsheim', 'Outfit', '"GT Walsheim VF"'), (3, 'circular', 'Poppins', '"Circular Std Bold"'), (4, 'inter', NULL, 'Inter'),
  (5, 'canela', 'Fraunces', '"Canela Light 2"'), (6, 'recifedisplay', 'Plus Jakarta Sans', '"Recife Display"'), (7, 'neuemontreal', 'Space Grotesk', 'Neue_Montreal-Medium'), (8, '', NULL, 'Bold'), (9, 'foundersgroteskxcondensed', 'Archivo', '"Founders Grotesk X-Condensed"'))
SELECT n_nationkey, font_key, substitute, css FROM nation JOIN f ON n_nationkey % 10 = i""",
    "n2_scores": """
WITH g AS (SELECT user_id, event_id % 5 AS token, max(value) / 10 AS px FROM events GROUP BY 1, 2),
m AS (SELECT user_id, px, list_extract([48.0::DOUBLE, 46, 40, 30, 13], CAST(token AS INTEGER) + 1) AS want FROM g),
t AS (SELECT user_id, count_if(CASE WHEN want > 20 THEN abs(want - px) <= want / 10 ELSE abs(want - px) <= 2 END) / 5.0::DOUBLE AS typography, count_if(abs(px - want) >= 2) AS mobile FROM m GROUP BY 1),
c AS (SELECT user_id, mobile, CASE WHEN user_id % 2 = 0 THEN 0.45::DOUBLE + 0.3::DOUBLE * typography + 0.2::DOUBLE ELSE 0.54::DOUBLE + 0.4::DOUBLE * typography END AS combined FROM t)
SELECT CASE WHEN combined < 0.7 THEN 'floor' WHEN user_id % 3 > 0 AND combined < 0.89 THEN 'regression' END AS failure, count(*) AS n, CAST(sum(mobile) AS BIGINT) AS mobile, CAST(CAST(floor(round(avg(combined), 9) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS mean FROM c GROUP BY 1""",
    "i24_loose_json": """
SELECT CASE WHEN event_id % 4 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, count(*) AS n FROM events GROUP BY 1""",
}
