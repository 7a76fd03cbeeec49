"""Measured colours of style nodes against the roles of a palette.

`nodes` has the fields that `sources.captures.style_nodes` gives (capture_id, ord, colors, states); `palette` has capture_id, ord, role
and hex, and at most one swatch for a role, so a capture's colours meet a bounded number of swatches. Rows without a capture_id, and
colours that are no CSS colour, match nothing; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import color as C
from weftline.plans.dialect import doubles

#: A colour has a role within this distance, and sits on the primary colour within the second.
ROLE_DISTANCE, PRIMARY_DISTANCE = 2.0, 1.5
COLOR_PROPERTIES = ("background-color", "color", "border-color")
NO_STATES = "array<struct<state:string,changes:array<struct<property:string,from:string,to:string>>>>"


def channels(css: Column) -> Column:
    """H1: (r, g, b) of a colour in hex of 3, 4, 6 or 8 digits or in rgb(a) notation; null for others."""
    text = F.lower(F.trim(css))
    digits = F.regexp_extract(text, "^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$", 1)
    digits = F.when(F.length(digits) < 5, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    numbers = r"^rgba?\(\s*([0-9.]+)[\s,]+([0-9.]+)[\s,]+([0-9.]+)(?:[\s,/]+[0-9.]+%?)?\s*\)$"
    from_hex = [F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("double") for k in range(3)]
    from_rgb = [F.regexp_extract(text, numbers, k + 1).try_cast("double") for k in range(3)]
    made = lambda parts: F.struct(*(p.alias(n) for p, n in zip(parts, "rgb", strict=True)))
    return F.when(digits != "", made(from_hex)).when(text.rlike(numbers), made(from_rgb))


def hex_of(css: Column) -> Column:
    """H2: #rrggbb without alpha; null for what is no colour."""
    parts = channels(css)
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(F.floor(parts[c] + 0.5))), 2, "0") for c in "rgb"))


def _layered(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *(doubles(f"{e} AS {n}") for n, e in layer.items()))
    return df


def _lab(df: DataFrame, css: str, prefix: str) -> DataFrame:
    parts = df.withColumn("_rgb", channels(F.col(css))).filter("_rgb IS NOT NULL")
    for c in "rgb":
        parts = parts.withColumn(prefix + c, F.col(f"_rgb.{c}"))
    return _layered(parts.drop("_rgb"), C.lab_layers(*(prefix + c for c in "rgb"), p=prefix))


def distances(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """H3: capture_id, css, role, swatch (its ord), de of each distinct colour of a capture and each swatch with a role."""
    a = _lab(colors.select("capture_id", "css").distinct(), "css", "a_")
    b = _lab(palette.filter("role IS NOT NULL").select("capture_id", F.col("ord").alias("swatch"), "role", F.col("hex").alias("swatch_hex")), "swatch_hex", "b_")
    met = _layered(a.join(b, "capture_id"), C.delta_e_layers())
    return met.groupBy("capture_id", "css", "role", "swatch").agg(F.min("de").alias("de"))


def nearest_roles(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """capture_id, css, role of the nearest swatch within ROLE_DISTANCE, the first among equals; colours without one have no row."""
    best = distances(colors, palette).groupBy("capture_id", "css").agg(F.min(F.struct("de", "swatch", "role")).alias("best"))
    return best.filter(F.col("best.de") <= ROLE_DISTANCE).select("capture_id", "css", "best.role")


def first_color(channel: str) -> Column:
    """The first value of a channel among a node's colours."""
    return F.get(F.filter("colors", lambda c: c["channel"] == channel), F.lit(0))["value"]


def base_color() -> Column:
    """A node's own colour: background, else text, else border."""
    return F.coalesce(*map(first_color, ("background", "text", "border")))


def shown(prop: Column, value: Column) -> Column:
    """A changed value as reports show it: colours in hex, everything else as it is."""
    return F.when(prop.isin(*COLOR_PROPERTIES), F.coalesce(hex_of(value), value)).otherwise(value)


def role_states(nodes: DataFrame, palette: DataFrame) -> DataFrame:
    """capture_id, place, target, state, changes (property, from, to).

    A node's states count for the role of its own colour; nodes without a role count for none. Of each property's changes the most
    frequent stays, the first seen among equals. Entries (place, from 1) and properties stand in the order they were first seen.
    """
    rows = nodes.select("capture_id", "ord", base_color().alias("css"), F.posexplode("states").alias("at", "s")).filter("css IS NOT NULL")
    rows = rows.join(nearest_roles(rows, palette), ["capture_id", "css"])
    seen = F.struct("ord", "at", "step").alias("seen")
    changes = rows.select("capture_id", "ord", "at", F.col("role").alias("target"), "s.state", F.posexplode_outer("s.changes").alias("step", "c"))
    changes = changes.select("capture_id", "target", "state", seen, "c.property", F.col("c.from").alias("old"), F.col("c.to").alias("new"))
    counts = changes.groupBy("capture_id", "target", "state", "property", "old", "new").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    modal = counts.groupBy("capture_id", "target", "state", "property").agg(F.min("seen").alias("seen"), F.min(F.struct(-F.col("n"), F.col("seen").alias("since"), "old", "new")).alias("best"))
    change = F.struct("seen", "property", shown(F.col("property"), F.col("best.old")).alias("from"), shown(F.col("property"), F.col("best.new")).alias("to"))
    kept = F.collect_list(F.when(F.col("property").isNotNull(), change))
    entries = modal.groupBy("capture_id", "target", "state").agg(F.min("seen").alias("seen"), F.array_sort(kept).alias("changes")).filter(F.size("changes") > 0)
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy("seen", "target", "state"))
    bare = F.transform("changes", lambda c: F.struct(c["property"].alias("property"), c["from"].alias("from"), c["to"].alias("to")))
    return entries.select("capture_id", place.alias("place"), "target", "state", bare.alias("changes"))


def on_primary(nodes: DataFrame, palette: DataFrame) -> DataFrame:
    """capture_id, hex, inferred for each capture with a primary colour.

    The most frequent text colour of nodes whose background is within PRIMARY_DISTANCE of the primary, the first seen among equals;
    without one, white or black, whichever contrasts more (white among equals), marked as inferred.
    """
    primary = palette.filter("role = 'primary'")
    worn = nodes.select("capture_id", "ord", first_color("background").alias("css"), hex_of(first_color("text")).alias("text")).filter("css IS NOT NULL AND text IS NOT NULL")
    close = distances(worn, primary).groupBy("capture_id", "css").agg(F.min("de").alias("de")).filter(F.col("de") <= PRIMARY_DISTANCE).select("capture_id", "css")
    counts = worn.join(close, ["capture_id", "css"], "left_semi").groupBy("capture_id", "text").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = counts.groupBy("capture_id").agg(F.min(F.struct(-F.col("n"), "first", "text")).alias("best"))
    lit = _lab(primary.groupBy("capture_id").agg(F.min_by("hex", "ord").alias("hex")), "hex", "a_").selectExpr("capture_id", f"{doubles(C.luminance('a_'))} AS lum")
    fallback = F.when(F.pow(F.col("lum") + 0.05, 2) <= 1.05 * 0.05, "#ffffff").otherwise("#000000")
    return lit.join(best, "capture_id", "left").select("capture_id", F.coalesce("best.text", fallback).alias("hex"), F.col("best").isNull().alias("inferred"))


def _with_states(own: Column, more: Column) -> Column:
    """The states of `more` put into `own`: a new state is added, a known one takes the properties that it lacks."""

    def with_changes(changes: Column, extra: Column) -> Column:
        return F.aggregate(extra, changes, lambda done, c: F.when(F.exists(done, lambda d: d["property"] == c["property"]), done).otherwise(F.array_append(done, c)))

    def put(done: Column, s: Column) -> Column:
        known = F.exists(done, lambda d: d["state"] == s["state"])
        widened = F.transform(done, lambda d: F.when(d["state"] == s["state"], F.struct(d["state"].alias("state"), with_changes(d["changes"], s["changes"]).alias("changes"))).otherwise(d))
        return F.when(known, widened).otherwise(F.array_append(done, s))

    return F.aggregate(more, own, put)


def merged_states(nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """The nodes with the states that a later read of style sheets found (extra: capture_id, ord, place, states).

    What a node has first stays; of extra rows for one node those of a lower place come first. Extra rows without a node are left out.
    """
    more = extra.groupBy("capture_id", "ord").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "states"))), lambda x: x["states"])).alias("_more"))
    none = F.array().cast(NO_STATES)
    states = _with_states(F.coalesce(F.col("states").cast(NO_STATES), none), F.coalesce(F.col("_more").cast(NO_STATES), none))
    kept = [c for c in nodes.columns if c != "states"]
    return nodes.join(more, ["capture_id", "ord"], "left").select(*kept, F.when(F.col("_more").isNull(), F.col("states").cast(NO_STATES)).otherwise(states).alias("states"))


def merged_keyframes(own: Column, more: Column) -> Column:
    """Keyframes of a capture and those of a later read whose names are new."""
    return F.aggregate(more, own, lambda done, k: F.when(F.exists(done, lambda d: d["name"] == k["name"]), done).otherwise(F.array_append(done, k)))
