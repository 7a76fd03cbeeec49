"""Scalar rules of styles, requests, names and scores as column expressions; they take any columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substitutes of well-known proprietary fonts, in order of preference, and the words that a font's name sheds.
FONT_SUBSTITUTES = (
    ("recifetext", "Plus Jakarta Sans"), ("recife", "Plus Jakarta Sans"), ("sohne", "Inter"), ("gtwalsheim", "Outfit"),
    ("neuemontreal", "Space Grotesk"), ("canela", "Fraunces"), ("foundersgrotesk", "Archivo"), ("circular", "Poppins"),
)
FONT_WORDS = "thin|hairline|extralight|ultralight|light|regular|book|std|buch|normal|medium|semibold|demibold|bold|extrabold|ultrabold|black|heavy|italic|oblique|vf|variable"
#: Latin letters with marks and those without.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
SITE_FLOOR, REGRESSION = 0.7, 0.01
MOBILE_STEP = 2


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def split_outside(text: Column) -> Column:
    """I4: a list parted at commas outside of parentheses, ends trimmed; a last empty part is none."""
    parts = F.transform(F.split(text, r",(?![^()]*\))", -1), lambda x: F.trim(x))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def number(text: Column) -> Column:
    """The number that a text starts with; 0 for none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def time_ms(text: Column) -> Column:
    """Milliseconds of a CSS time."""
    t = F.lower(F.trim(text))
    return F.when(t.endswith("s") & ~t.endswith("ms"), number(t) * 1000).otherwise(number(t))


def transitions(durations: Column, properties: Column, timings: Column, delays: Column) -> Column:
    """An array of (property, duration_ms, timing, delay_ms); what a list lacks is taken from its first entry; without a duration there is no transition."""
    lists = [split_outside(F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(c)) for c, default in ((properties, "all"), (timings, "ease"), (delays, "0s"))]
    at = lambda own, i, default: F.coalesce(F.nullif(F.get(own, i), F.lit("")), F.nullif(F.get(own, F.lit(0)), F.lit("")), F.lit(default))
    made = F.transform(split_outside(durations), lambda d, i: F.struct(at(lists[0], i, "all").alias("property"), time_ms(d).alias("duration_ms"), at(lists[1], i, "ease").alias("timing"), time_ms(at(lists[2], i, "0s")).alias("delay_ms")))
    return F.filter(made, lambda x: x["duration_ms"] > 0)


def border_color(sides: Column) -> Column:
    """The colour of the widest painted side, the first among equals. sides: array of (width, style, color), from the top clockwise; color is null where it is clear."""
    painted = F.filter(sides, lambda x: (x["width"] > 0) & ~x["style"].isin("none", "hidden") & x["color"].isNotNull())
    widest = F.array_max(F.transform(painted, lambda x: x["width"]))
    return F.get(F.filter(painted, lambda x: x["width"] == widest), F.lit(0))["color"]


def semantic_context(role: Column, invalid: Column) -> Column:
    """Alert, invalid or null."""
    return F.when(role.isin("alert", "status"), "alert").when(invalid == "true", "invalid")


def signature(tag: Column, child_tags: Column, w: Column, h: Column) -> Column:
    """Tag, the first five child tags, and the size by steps of 25."""
    step = lambda x: (half_up(x / 25) * 25).cast("string")
    return F.concat(tag, F.lit("["), F.array_join(F.slice(child_tags, 1, 5), ","), F.lit("]_"), step(w), F.lit("x"), step(h))


def columns_of(display: Column, template: Column) -> Column:
    """Columns of a grid; null where the display is none."""
    return F.when(F.contains(display, F.lit("grid")), F.size(F.filter(F.split(F.coalesce(template, F.lit("")), r"\s+"), lambda x: x != "")))


def spread(items: Column, most: int) -> Column:
    """At most `most` items, evenly spread, both ends among them."""
    n = F.size(items)
    return F.when(n <= most, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, half_up(i * (n - 1) / (most - 1)).cast("int"))))


def client_id(forwarded: Column, real: Column) -> Column:
    """The first forwarded address, else the real one, else unknown."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(filled(F.get(F.split(forwarded, ","), F.lit(0))), filled(real), F.lit("unknown"))


def without_data_url(image: Column) -> Column:
    """A base64 text without its data URL prefix."""
    return F.regexp_replace(image, r"^data:image/[a-zA-Z0-9.+-]+;base64,", "")


def media_type(image: Column) -> Column:
    """The media type of a base64 image by its first bytes; PNG where they say nothing."""
    head = F.hex(F.substring(F.try_to_binary(F.substring(image, 1, 16), F.lit("base64")), 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.rlike("^52494646.{8}57454250"), "image/webp").otherwise("image/png")


def positive(raw: Column, fallback: float) -> Column:
    """A positive number, else the fallback."""
    x = F.trim(raw).try_cast("double")
    return F.when(x > 0, x).otherwise(F.lit(float(fallback)))


def positive_integer(raw: Column, fallback: int) -> Column:
    """A positive number without its fraction, else the fallback."""
    x = F.floor(positive(raw, fallback))
    return F.when(x < 1, F.lit(fallback)).otherwise(x).cast("long")


def font_key(name: Column) -> Column:
    """A font's name without marks, weights, digits and punctuation."""
    x = F.translate(name, MARKED, PLAIN)
    x = F.regexp_replace(x, rf"(?i)[_\s-]*({FONT_WORDS})\b", "")
    return F.lower(F.regexp_replace(x, "[^a-zA-Z]", ""))


def font_substitute(name: Column) -> Column:
    """The substitute of a font, by its whole key, then by the first key that it starts with; else null."""
    key = font_key(name)
    exact = [F.when(key == k, v) for k, v in FONT_SUBSTITUTES]
    return F.coalesce(*exact, *(F.when(key.startswith(k), v) for k, v in FONT_SUBSTITUTES))


def css_font(name: Column) -> Column:
    """Quoted where it has white space."""
    return F.when(name.rlike(r"\s"), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)


def percent(x: Column) -> Column:
    """I17."""
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def mobile_size(size: Column, mobile: Column) -> Column:
    """The mobile size of a step where it differs by at least MOBILE_STEP."""
    return F.when(F.abs(mobile - size) >= MOBILE_STEP, half_up(mobile))


def size_matches(expected: Column, got: Column) -> Column:
    """Within 2 or a tenth, whichever is more; a missing size does not match."""
    return F.coalesce(F.abs(expected - got) <= F.greatest(F.lit(2.0), expected * 0.1), F.lit(False))


def combined_score(palette: Column, typography: Column, structure: Column) -> Column:
    """Halves, three tenths and a fifth with a structure, three and two fifths without; a missing typography counts as the palette."""
    return F.when(structure.isNotNull(), palette * 0.5 + F.coalesce(typography, palette) * 0.3 + structure * 0.2).otherwise(F.when(typography.isNull(), palette).otherwise(palette * 0.6 + typography * 0.4))


def gate(combined: Column, baseline: Column) -> Column:
    """Why a site fails: floor, regression or null."""
    return F.when(combined < SITE_FLOOR, "floor").when(combined < baseline - REGRESSION, "regression")


def loose_json(text: Column) -> Column:
    """The text if it is JSON, else what stands between its first and last brace if that is; else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(text), valid(F.nullif(inner, F.lit(""))))


PAD_SNAP, GAP_SNAP, FOLD_SHARE = 4, 2, 0.92


def nearest_step(value: Column, scale: Column, tolerance: float) -> Column:
    """The step of a scale that is nearest, the first among equals; null beyond the tolerance or without a scale."""
    near = F.array_min(F.transform(scale, lambda s, i: F.struct(F.abs(s - value).alias("gap"), i.alias("at"), s.alias("step"))))
    return F.when(near["gap"] <= tolerance, near["step"])


def radius_token(raw: Column) -> Column:
    """One radius for all corners; pills are 9999px; none and mixed corners are null."""
    text = F.trim(raw)
    parts = F.split(text, r"\s+")
    plain = F.when(F.forall(parts, lambda p: p == F.get(parts, F.lit(0))), F.get(parts, F.lit(0)))
    return F.when(text.isin("", "0", "0px"), None).when((text == "50%") | F.contains(text, F.lit("999")), "9999px").otherwise(plain)


def token_hint(role: Column, radius: Column, radii: Column, gap: Column, spacing: Column) -> Column:
    """I16: role of the background, radius and gap where the report has them; null where it has none of them."""
    token = radius_token(radius)
    step = F.when(gap != 0, nearest_step(half_up(gap), spacing, GAP_SNAP))
    parts = F.array_compact(F.array(F.concat(F.lit("bg="), role), F.when(F.array_contains(radii, token), F.concat(F.lit("radius="), token)), F.concat(F.lit("gap="), step.cast("long").cast("string"), F.lit("px"))))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · "))


def pad_y(top: Column, bottom: Column, spacing: Column) -> Column:
    """The mean of the paddings, at a near step of the scale; null where one is missing or below 0."""
    mean = (top + bottom) / 2
    px = F.coalesce(nearest_step(mean, spacing, PAD_SNAP).cast("long"), half_up(mean).cast("long"))
    return F.when((top >= 0) & (bottom >= 0), F.concat(F.lit("padY "), px.cast("string"), F.lit("px")))


def region_height(annotation: Column, kind: Column, height: Column, viewport: Column, padding: Column) -> Column:
    """The height in a region's annotation gives way to 100vh where it fills the fold, else to its padding; pinned regions, those without bounds and other nodes stay."""
    measured = F.regexp_extract(annotation, "h [0-9]+px", 0)
    stays = (kind != "region") | kind.isNull() | annotation.isNull() | (measured == "") | height.isNull() | annotation.rlike("sticky|fixed")
    put = F.when(height >= viewport * FOLD_SHARE, "h 100vh").otherwise(F.coalesce(padding, measured))
    return F.when(stays, annotation).otherwise(F.overlay(annotation, put, F.position(measured, annotation), F.length(measured)))
