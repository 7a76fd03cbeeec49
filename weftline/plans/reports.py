"""Queries of reports and region rules over the test tables, each with SQL of its own. An order stands for a capture, its lines for tokens; their number by order does not grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import styles as S
from weftline.operators import report

ROLES = ("primary", "accent", "text")


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"), "l_linestatus")
    hexed = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("l_partkey") % 16777216)), 6, "0"))
    color = F.struct(
        F.get(F.array(*map(F.lit, ROLES)), (F.col("l_linenumber") - 1).cast("int")).alias("role"), hexed.alias("hex"), F.when(F.col("l_linenumber") % 2 == 0, "fills").alias("usage"), F.col("d").alias("area"),
        F.lit(False).alias("image_sourced"), (F.col("l_linestatus") == "O").alias("inferred"),
    )
    rows = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", color.alias("c"), "q"))).alias("lines"))
    made = F.lit("measured").alias("provenance")
    pair = F.struct(F.lit("text").alias("fore"), F.lit("primary").alias("back"), F.lit(4.5).alias("ratio"), F.lit("AA").alias("grade"))
    contrast = F.when(F.size("lines") > 3, F.array(pair)).otherwise(F.array().cast("array<struct<fore:string,back:string,ratio:double,grade:string>>"))
    scale = F.transform("lines", lambda x: x["q"])
    return rows.select(
        "l_orderkey", F.struct(made, F.transform("lines", lambda x: x["c"]).alias("colors"), contrast.alias("contrast")).alias("palette"), F.struct(made, F.lit(4.0).alias("base"), scale.alias("scale")).alias("spacing"),
        F.when(F.col("l_orderkey") % 2 == 0, F.struct(made, F.transform(scale, lambda q: F.concat(report.number_text(q / 2), F.lit("px"))).alias("scale"))).alias("radius"),
    )


def palettes(spark, sf_dir):
    return _lanes(spark, sf_dir).select("l_orderkey", report.palette_text(F.col("palette")).alias("body"))


def scales(spark, sf_dir):
    return _lanes(spark, sf_dir).select("l_orderkey", report.spacing_text(F.col("spacing")).alias("spacing"), report.radius_text(F.col("radius")).alias("radius"))


def hints(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    radius = F.when(n == 1, "0px").when(n == 2, "50%").when(n == 3, " 4px 4px ").when(n == 4, "4px 8px").otherwise("6px")
    hint = S.token_hint(F.when(F.col("l_linestatus") == "O", "surface"), radius, F.array(F.lit("4px"), F.lit("9999px")), q / 2, F.array(*(F.lit(x) for x in (4.0, 8.0, 16.0))))
    return line.groupBy(hint.alias("hint")).agg(F.count(F.lit(1)).alias("n"))


def heights(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    note = F.when(n == 1, F.lit("flex row")).when(n == 2, F.lit("h 64px · sticky")).otherwise(F.concat(F.lit("grid · h "), q.cast("long").cast("string"), F.lit("px · h 9px")))
    pad = S.pad_y(q - 3, F.lit(9.0), F.when(n != 4, F.array(*(F.lit(x) for x in (0.0, 8.0, 24.0)))))
    own = S.region_height(note, F.when(n != 5, "region").otherwise("block"), q, F.lit(50.0), pad)
    return line.groupBy(own.alias("annotation")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"k3_palette_text": palettes, "k5_scale_text": scales, "i16_token_hints": hints, "j5_region_heights": heights}

ORACLES = {
    "k3_palette_text": """
SELECT l_orderkey, '## Palette' || chr(10) || chr(10) || string_agg('- ' || CASE l_linenumber WHEN 1 THEN '**primary** ' WHEN 2 THEN '**accent** ' WHEN 3 THEN '**text** ' ELSE '' END || '`#' || printf('%06x', l_partkey % 16777216) || '`'
       || CASE WHEN l_linenumber % 2 = 0 THEN ' — fills' ELSE '' END || ' · area ' || CAST(floor(CAST(l_discount AS DOUBLE) * 100 + 0.5) AS BIGINT) || '%' || CASE WHEN l_linestatus = 'O' THEN ' · inferred' ELSE '' END, chr(10) ORDER BY l_linenumber, l_partkey, l_discount, l_linestatus = 'O')
       || CASE WHEN count(*) > 3 THEN chr(10) || chr(10) || '**Contrast**' || chr(10) || chr(10) || '- text on primary: 4.5:1 (AA)' ELSE '' END AS body
FROM lineitem GROUP BY l_orderkey""",
    "k5_scale_text": """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_linestatus = 'O' AS open, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, '## Spacing' || chr(10) || chr(10) || 'Base unit: `4px`' || chr(10) || chr(10) || 'Scale (px): `[' || string_agg(CAST(q AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_discount, open, q) || ']`' AS spacing,
       CASE WHEN l_orderkey % 2 = 0 THEN '## Radius' || chr(10) || chr(10) || 'Scale: `[' || string_agg(CAST(q // 2 AS VARCHAR) || CASE WHEN q % 2 = 1 THEN '.5px' ELSE 'px' END, ', ' ORDER BY l_linenumber, l_partkey, l_discount, open, q) || ']`' END AS radius
FROM q GROUP BY l_orderkey""",
    "i16_token_hints": """
WITH g AS (SELECT *, CAST(floor(CAST(l_quantity AS DOUBLE) / 2 + 0.5) AS BIGINT) AS g FROM lineitem)
SELECT nullif(concat_ws(' · ', CASE WHEN l_linestatus = 'O' THEN 'bg=surface' END, CASE l_linenumber WHEN 2 THEN 'radius=9999px' WHEN 3 THEN 'radius=4px' END,
       CASE WHEN l_quantity = 0 THEN NULL WHEN g BETWEEN 2 AND 6 THEN 'gap=4px' WHEN g BETWEEN 7 AND 10 THEN 'gap=8px' WHEN g BETWEEN 14 AND 18 THEN 'gap=16px' END), '') AS hint, count(*) AS n
FROM g GROUP BY 1""",
    "j5_region_heights": """
WITH q AS (SELECT l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, CAST(l_quantity AS BIGINT) AS i FROM lineitem), m AS (SELECT *, (q - 3 + 9) / 2 AS mean FROM q),
p AS (SELECT *, CASE WHEN q < 3 THEN NULL WHEN n <> 4 AND mean <= 4 THEN 'padY 0px' WHEN n <> 4 AND mean BETWEEN 4 AND 12 THEN 'padY 8px' WHEN n <> 4 AND mean BETWEEN 20 AND 28 THEN 'padY 24px' ELSE 'padY ' || CAST(floor(mean + 0.5) AS BIGINT) || 'px' END AS pad FROM m)
SELECT CASE WHEN n = 1 THEN 'flex row' WHEN n = 2 THEN 'h 64px · sticky' WHEN n = 5 THEN 'grid · h ' || i || 'px · h 9px' WHEN q >= 46 THEN 'grid · h 100vh · h 9px' ELSE 'grid · ' || coalesce(pad, 'h ' || i || 'px') || ' · h 9px' END AS annotation, count(*) AS n
FROM p GROUP BY 1""",
}
